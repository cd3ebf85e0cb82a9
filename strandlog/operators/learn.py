"""Template induction: one pattern from several lines of a group, by relational steps.

Lines are cut into runs of digits, letters, white space and other characters. At each place the
runs of all lines that reach it are compared: one value is static, several are a typed variable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.functions.templates import IP, regex_escape
from strandlog.functions.tokens import char_class_tokens

# What stands for a variable of each type, and its name.
VARIABLES = {
    "number": (r"(\d+)", "number"), "unix_timestamp": (r"(\d{10,})", "timestamp"), "hex_number": ("(0x[0-9a-fA-F]+|[0-9a-fA-F]+)", "hex_number"),
    "uuid": ("([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})", "uuid"), "string": (r"(\S+)", "value"),
}


def _pick(kind: Column, index: int) -> Column:
    out = F.lit(None).cast("string")
    for name, values in VARIABLES.items():
        out = F.when(kind == name, values[index]).otherwise(out)
    return out


def position_types(samples: DataFrame, group: str, message: str = "message") -> DataFrame:
    """(group, pos, value, kind): kind is static, or the type of a place where values differ."""
    runs = samples.select(group, F.posexplode(char_class_tokens(F.col(message))).alias("pos", "v"))
    v = F.col("v")
    timestamp = v.rlike("^[0-9]{10}$") & (F.expr("try_cast(v as bigint)") <= 4294967295)
    found = runs.groupBy(group, "pos").agg(
        F.min("v").alias("value"), F.max("v").alias("top"), F.bool_and(v.rlike("^[0-9]+$")).alias("digits"), F.bool_or(timestamp).alias("stamp"),
        F.bool_and(v.rlike("^[0-9A-Fa-f]+$")).alias("hex"), F.bool_or(v.rlike("^[^-]*-[^-]*-[^-]*-[^-]*-[^-]*$")).alias("dashes"))
    varied = F.when(F.col("digits"), F.when(F.col("stamp"), "unix_timestamp").otherwise("number")).when(F.col("hex"), "hex_number").when(F.col("dashes"), "uuid").otherwise("string")
    return found.select(group, "pos", "value", F.when(F.col("value") == F.col("top"), "static").otherwise(varied).alias("kind"))


def learn_patterns(samples: DataFrame, group: str, message: str = "message") -> DataFrame:
    """(group, pattern, variables) of each group; a group of one line has only its IP addresses masked."""
    places = position_types(samples, group, message)
    names = F.when(F.col("kind") != "static", _pick(F.col("kind"), 1))
    nth = F.row_number().over(Window.partitionBy(group, names).orderBy("pos"))
    named = places.withColumn("name", names).withColumn("nth", nth)
    part = F.when(F.col("kind") == "static", regex_escape(F.col("value"))).otherwise(_pick(F.col("kind"), 0))
    name = F.when(F.col("nth") == 1, F.col("name")).otherwise(F.concat("name", F.lit("_"), F.col("nth").cast("string")))
    rows = named.select(group, "pos", part.alias("part"), F.when(F.col("name").isNotNull(), name).alias("name"))
    built = rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("pos", "part", "name"))).alias("p"))
    many = built.select(group, F.array_join(F.transform("p", lambda x: x["part"]), "").alias("pattern"), F.transform(F.filter("p", lambda x: x["name"].isNotNull()), lambda x: x["name"]).alias("variables"))
    counts = samples.groupBy(group).agg(F.count("*").alias("n"), F.first(message).alias("only"))
    joined = counts.join(many, group, "left")
    single = F.col("n") == 1
    return joined.select(group, F.when(single, single_pattern(F.col("only"))).otherwise(F.coalesce("pattern", F.lit(""))).alias("pattern"),
                         F.when(single, single_variables(F.col("only"))).otherwise(F.coalesce("variables", F.array().cast("array<string>"))).alias("variables"))


def _ips(message: Column) -> Column:
    return F.regexp_extract_all(message, F.lit(rf"\b{IP}\b"), F.lit(0))


def single_pattern(message: Column) -> Column:
    """The escaped line with IP addresses as groups."""
    static = F.transform(F.split(message, rf"\b{IP}\b", -1), regex_escape)
    return F.array_join(static, f"({IP})")


def single_variables(message: Column) -> Column:
    return F.transform(_ips(message), lambda _: F.lit("ip_address"))
