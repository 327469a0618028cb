"""Training-data operators: thirteen Spark jobs over tables of documents, pages and conversations.

Nothing else in the library imports this subpackage.
"""
