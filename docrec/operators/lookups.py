"""Dimension look-ups and the 43-column layout.

Dimensions are small tables in file order (``ord``); Spark decides by their size whether to broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docrec.functions.scalar import normalize_key, split_date
from docrec.operators.matching import found_patterns
from docrec.session import stored

#: Invented dimension values; a deployment brings its own, see ``load_lookups``.
CARRIERS = [("maeu", "MAEU", "MERIDIAN"), ("medu", "MEDX", "MEDIA LINES"), ("hlcu", "HLCX", "HELIOS"), ("zim", "ZIMX", "ZENITH")]
CONTAINERS = [("40hc", "40H", 2), ("45hc", "45H", 2), ("40rf", "40R", 2)]
PORTS = [("nation_1", "ONE01", "ON", "FIRSTLAND", "Port One"), ("nation_2", "TWO01", "TW", "SECONDLAND", "Port Two"), ("nation_20", "TWY01", "TY", "TWENTYLAND", "Port Twenty"), ("nation_7", "SEV01", "SE", "SEVENLAND", "Port Seven"), ("port of", "ANY01", "AN", "ANYLAND", "Any Port")]
MOVEMENTS = [("cy/cy", "FCLFCL"), ("cfs/cfs", "LCLLCL")]
#: Names of months.
MONTHS = ["Janvier", "Février", "Mars", "Avril", "Mai", "Juin", "Juillet", "Août", "Septembre", "Octobre", "Novembre", "Décembre"]
#: Invented values but for the freight code, a fixed value.
DEFAULTS = {"handler": "HANDLER", "direction": "I", "call_port": "HOME", "mode": "FCLFCL", "qualified": "Oui", "system": "DOCREC", "freight": "210530003"}

#: The columns of the target layout, in order.
LAYOUT = (
    "Numéro escale", "Consignataire", "Navire", "Armateur escale", "Numéro BL", "I_IMP_E_EXP", "Type fret", "Armateur BL", "Port de chargement",
    "Port de déchargement", "Port transbo1", "Port transbo2", "Port escale", "Code transitaire", "Transitaire", "chargeur.code", "Chargeur",
    "CODE_MODE_EXPEDITION", "Destinataire", "Manutentionaire", "Code marchandise", "Libellé marchandise", "POIDS_MARCHANDISE", "Nombre de TC",
    "NOMBRE_TEU", "Nombre de colis", "volume marchandise", "CODE_CONDIT", "Pays de prise en charge", "code_lieu_prise_charge",
    "Lieu de prise en charge", "Pays de livraison", "Code lieu livraison", "Lieu de livraison", "Année escale", "Mois escale", "Jour escale",
    "Qualifié?", "Index", "Range", "code armateur", "code pays", "système",
)


def dimensions(spark: SparkSession) -> dict[str, DataFrame]:
    make = lambda rows, cols: spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], f"{cols}, ord int")
    return {
        "carrier": make(CARRIERS, "prefix string, code string, name string"), "container": make(CONTAINERS, "type string, condit string, teu int"),
        "port": make(PORTS, "key string, code string, country_code string, country string, city string"), "movement": make(MOVEMENTS, "key string, mode string"),
    }


#: The maps of a look-ups file: their keys' name, and the fields of each entry (none: the entry is a plain text).
MAPS = {"carrier": ("prefix", ("code", "name")), "container": ("type", ("condit", "teu")), "port": ("key", ("code", "country_code", "country", "city")), "movement": ("key", ()), "month": ("key", ()), "default": ("key", ())}
PLAIN = {"movement": "mode", "month": "name", "default": "value"}


def load_lookups(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The six maps of a JSON file as dimensions with ``ord``, the place in the file.

    A key that is repeated keeps its first place and takes its last entry; a map that is missing, or null, is an empty
    dimension; a field that is missing is null. Keys are lower-cased and trimmed, white space inside counts as one space.
    """
    parts = (f"{name} map<string,{'struct<' + ','.join(f'{f}:string' for f in fields) + '>' if fields else 'string'}>" for name, (_, fields) in MAPS.items())
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", ", ".join(parts)).alias("file"))

    def dimension(name: str) -> DataFrame:
        key, fields = MAPS[name]
        rows = whole.select(F.posexplode(f"file.{name}").alias("ord", "k", "v")).select("ord", normalize_key(F.col("k")).alias(key), "v")
        rows = rows.groupBy(key).agg(F.min("ord").alias("ord"), F.max_by("v", "ord").alias("v"))
        values = [F.col(f"v.{f}").cast("int" if f == "teu" else "string").alias(f) for f in fields] or [F.col("v").alias(PLAIN[name])]
        return rows.select(key, *values, "ord")

    return {name: dimension(name) for name in MAPS}


def _first(values: DataFrame, candidates: DataFrame, key: str, out: list[str]) -> DataFrame:
    """For each key the candidate with the lowest (priority, ord)."""
    best = candidates.groupBy(key).agg(F.min_by(F.struct(*out), F.struct("priority", "ord")).alias("best"))
    return values.join(best, key, "left")


def with_carrier(rows: DataFrame, dim: DataFrame, bl: str = "bl", fallback: str = "fallback") -> DataFrame:
    """Adds ``code, name``: by the first 4 letters, else the first key that starts with the first 3, else by name, else the fallback as it is.

    Each way is an equi-join with the dimension, of which every key has one row, so the rows are not dealt anew while the dimension is small enough for Spark to broadcast it.
    """
    best = lambda d, key: d.groupBy(key).agg(F.min_by(F.struct("code", "name"), "ord").alias(f"_{key}v"))
    p4, p3 = F.lower(F.substring(bl, 1, 4)), F.lower(F.substring(bl, 1, 3))
    exact = best(dim.select(F.col("prefix").alias("_p4"), "code", "name", "ord"), "_p4")
    begun = best(dim.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.substring("prefix", F.lit(1), n)))).alias("_p3"), "code", "name", "ord"), "_p3")
    named = best(dim.select(normalize_key(F.col("name")).alias("_n"), "code", "name", "ord").where("_n <> ''"), "_n")
    out = rows.withColumns({"_p4": p4, "_p3": F.nullif(p3, F.lit("")), "_n": normalize_key(F.col(fallback))})
    for d, key in ((exact, "_p4"), (begun, "_p3"), (named, "_n")):
        out = out.join(d, key, "left")
    found = F.coalesce("__p4v", "__p3v", "__nv")
    return out.withColumns({"code": F.coalesce(found["code"], F.lit("")), "name": F.coalesce(found["name"], F.col(fallback), F.lit(""))}).drop("_p4", "_p3", "_n", "__p4v", "__p3v", "__nv")


def carrier(bills: DataFrame, dim: DataFrame) -> DataFrame:
    """``bl, fallback`` -> their ``code, name``, see ``with_carrier``; a row for each distinct pair."""
    return with_carrier(bills.select("bl", "fallback").distinct(), dim)


def with_container_type(rows: DataFrame, dim: DataFrame, ctype: str = "ctype") -> DataFrame:
    """Adds ``condit, teu``: exact, else two leading digits and S with 2 TEU for 40 and 45 and else 1, else empty and 0."""
    key = F.replace(normalize_key(F.col(ctype)), F.lit(" "), F.lit(""))
    size = F.regexp_extract("_key", "^([0-9]{2})", 1)
    known = dim.select(F.col("type").alias("_key"), F.col("condit").alias("_condit"), F.col("teu").alias("_teu"))
    condit = F.coalesce("_condit", F.when(size != "", F.concat(size, F.lit("S"))), F.lit(""))
    teu = F.coalesce("_teu", F.when(size.isin("40", "45"), 2).when(size != "", 1).otherwise(0))
    return rows.withColumn("_key", key).join(known, "_key", "left").withColumns({"condit": condit, "teu": teu.cast("int")}).drop("_key", "_condit", "_teu")


def container_type(types: DataFrame, dim: DataFrame) -> DataFrame:
    return with_container_type(types.select("ctype").distinct(), dim)


def port(names: DataFrame, dim: DataFrame) -> DataFrame:
    """``port`` -> ``code, country_code, country, city``: exact, else the first key contained in the name, else the name as the city."""
    keys = names.select("port").distinct().withColumn("key_", normalize_key(F.col("port")))
    exact = keys.join(dim, F.col("key_") == F.col("key")).withColumn("priority", F.lit(0))
    inside = found_patterns(keys, dim.select(F.col("key").alias("pattern"), F.lit(False).alias("whole")), "key_")
    part = inside.join(dim, F.col("pattern") == F.col("key")).drop("pattern").withColumn("key_", F.lit(None).cast("string")).withColumn("priority", F.lit(1))
    out = _first(keys.select("port"), exact.unionByName(part), "port", ["code", "country_code", "country", "city"])
    empty = lambda c: F.coalesce(F.col(f"best.{c}"), F.lit("")).alias(c)
    return out.select("port", empty("code"), empty("country_code"), empty("country"), F.coalesce("best.city", "port").alias("city"))


def with_movement(rows: DataFrame, dim: DataFrame, movement: str = "movement") -> DataFrame:
    """Adds ``mode``, the default where the dimension does not have it."""
    known = dim.select(F.col("key").alias("_key"), F.col("mode").alias("_mode"))
    return rows.withColumn("_key", normalize_key(F.col(movement))).join(known, "_key", "left").withColumn("mode", F.coalesce("_mode", F.lit(DEFAULTS["mode"]))).drop("_key", "_mode")


def movement(names: DataFrame, dim: DataFrame) -> DataFrame:
    return with_movement(names.select("movement").distinct(), dim)


def to_layout(records: DataFrame, dims: dict[str, DataFrame], overrides: dict[str, str] | None = None) -> DataFrame:
    """Records -> the 43 columns of the target layout behind ``doc_id, row_no``. Delivery falls back to discharge, acceptance to loading; the discharge port shows the delivery city."""
    have = set(records.columns)
    s = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in have else F.lit("")
    or_ = lambda a, b: F.when(a != "", a).otherwise(b)
    r = records.select(
        "doc_id", "row_no", s("bl_number").alias("bl"), s("shipowner").alias("fallback"), s("vessel").alias("vessel"), s("bl_type").alias("bl_type"), s("freight_forwarder").alias("forwarder"),
        *(s(c).alias(c) for c in ("shipper", "consignee", "description", "weight", "volume", "pack_qty", "movement")), s("container_number").alias("container"), s("container_type").alias("ctype"),
        s("port_of_loading").alias("pol"), s("port_of_discharge").alias("pod"), or_(s("place_of_delivery"), s("port_of_discharge")).alias("delivery"), or_(s("place_of_acceptance"), s("port_of_loading")).alias("acceptance"), s("date_of_arrival").alias("date"),
    )
    r = stored(r, "layout-records")  # the ports' names are read from it, then the rest
    ports = port(r.select(F.explode(F.array("pol", "delivery", "acceptance")).alias("port")), dims["port"])
    side = lambda name: ports.select(F.col("port").alias(name), F.struct("code", "country_code", "country", "city").alias(f"{name}_"))
    j = with_movement(with_container_type(with_carrier(r, dims["carrier"]), dims["container"]), dims["movement"])
    j = j.join(side("pol"), "pol").join(side("delivery"), "delivery").join(side("acceptance"), "acceptance")
    year, month, day = split_date(F.col("date"), MONTHS)
    e, d = F.lit(""), {k: F.lit(v) for k, v in DEFAULTS.items()}
    values: list[Column] = [
        e, d["handler"], F.col("vessel"), F.col("name"), F.col("bl"), d["direction"], or_(F.col("bl_type"), d["freight"]), F.col("name"), or_(F.col("pol_.city"), F.col("pol")),
        or_(F.col("delivery_.city"), F.col("pod")), e, e, d["call_port"], e, F.col("forwarder"), e, F.col("shipper"),
        F.col("mode"), F.col("consignee"), e, e, F.col("description"), F.col("weight"), F.when(F.col("container") != "", "1").otherwise(""),
        F.when(F.col("teu") != 0, F.col("teu").cast("string")).otherwise(""), F.col("pack_qty"), F.col("volume"), F.col("condit"), F.col("acceptance_.country"), F.col("acceptance_.code"),
        or_(F.col("acceptance_.city"), F.col("acceptance")), F.col("delivery_.country"), F.col("delivery_.code"), or_(F.col("delivery_.city"), F.col("delivery")), year, month, day,
        d["qualified"], e, e, F.col("code"), F.col("delivery_.country_code"), d["system"],
    ]
    fixed = overrides or {}
    return j.select("doc_id", "row_no", *((F.lit(fixed[c]) if c in fixed else v).alias(c) for c, v in zip(LAYOUT, values)))


def layout_rank(layout: DataFrame) -> DataFrame:
    return layout.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("row_no")))
