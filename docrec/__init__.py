"""docrec: document-record extraction as Spark DataFrame operators."""
