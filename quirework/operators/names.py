"""Free names over many files: every unsafe path gets the first name of its chain that nobody has.

The chain of a candidate ``a.x`` is ``a.x``, ``a-2.x``, ``a-2-3.x``, ``a-2-3-4.x`` and so on.  Safe paths
keep their names, which are taken from the start; the others come in order.  A name lies in its own
chain and in one more at most, the one that is left when ``-2-3-...-k`` is cut off its end, so only
candidates that come down to one root can ever want the same name.

Where one candidate has a root to itself, its files are numbered in order (in two levels, so a
candidate that all files share is many tasks) and step over the taken places of the chain: the j-th file, from 0, is behind
as many taken places r_i (the i-th, from 1) as have ``r_i - i <= j``.  Only roots with several candidates are gone
through file by file, each root by itself.

Paths and the last names of a chain may be long, of some thousand characters a file.  Where a path is made of
narrower columns, those alone are shuffled: it is made once to read its candidate off, which a written
table keeps, and once for the result.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import text as t
from quirework.operators import segments
from quirework.session import shared_folder


def stem(name: Column) -> Column:
    """What stands before the last dot, unless that is the first character."""
    return F.when(F.length(name) - F.length(F.substring_index(name, ".", -1)) > 1, F.regexp_extract(name, "(?s)^(.*)\\.[^.]*$", 1)).otherwise(name)


def ending(name: Column) -> Column:
    return F.substring(name, F.length(stem(name)) + 1, F.length(name))


def numbers(name: Column) -> Column:
    """The numbers at the end of a stem, as text."""
    return F.filter(F.split(F.regexp_extract(stem(name), "((?:-[1-9][0-9]*)*)$", 1), "-"), lambda x: x != "")


def cut(nums: Column, have: Column) -> Column:
    """How many of the first ``have`` numbers are left when the ``2, 3, ... k`` at their end is cut off, once."""
    k = F.get(nums, have - 1).try_cast("int")
    chain = F.transform(F.sequence(F.lit(2), F.greatest(F.least(k, have + 1), F.lit(2))), lambda x: x.cast("string"))
    fits = (have > 0) & (k >= 2) & (k - 1 <= have)
    return F.when(fits & F.coalesce(F.slice(nums, F.greatest(have - k + 2, F.lit(1)), F.greatest(k - 1, F.lit(0))) == chain, F.lit(False)), have - k + 1).otherwise(have)


def within(name: Column, have: Column) -> Column:
    """The name with only the first ``have`` of its numbers."""
    nums = numbers(name)
    lost = F.aggregate(F.slice(nums, have + 1, F.greatest(F.size(nums) - have, F.lit(0))), F.lit(0), lambda n, x: n + 1 + F.length(x))
    return F.concat(F.substring(stem(name), F.lit(1), F.length(stem(name)) - lost), ending(name))


def parent(name: Column) -> Column:
    return within(name, cut(numbers(name), F.size(numbers(name))))


def root(name: Column) -> Column:
    nums = numbers(name)
    return within(name, F.aggregate(nums, F.size(nums), lambda have, _: cut(nums, have)))


def place(name: Column) -> Column:
    """The place of a name in the chain of its parent."""
    nums = numbers(name)
    return F.size(nums) - cut(nums, F.size(nums)) + 1


def chained(name: Column, at: Column) -> Column:
    """The name at a place of a candidate's chain."""
    tail = F.when(at > 1, F.concat(F.lit("-"), F.array_join(F.sequence(F.lit(2), F.greatest(at.cast("int"), F.lit(2))).cast("array<string>"), "-"))).otherwise(F.lit(""))
    return F.concat(stem(name), tail, ending(name))


def free_names(files: DataFrame, group: str, order: str, path: str, made: Column | None = None) -> DataFrame:
    """(group, order, path, new_path); ``order`` is an integer, paths are distinct within a group.

    ``made`` says how ``path``, which is no column of ``files`` then, is made of the columns it has.
    """
    spark = files.sparkSession
    # so many tasks, whatever the size of the narrow rows that long names are made of
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    whole = F.col(path) if made is None else made
    rows = files if made is None else files.repartition(parts, group, order)
    safe = F.coalesce(whole.rlike(t.SAFE_PATH), F.lit(False))
    rows = rows.select(F.monotonically_increasing_id().alias("id"), F.struct("*").alias("p"), F.col(group).alias("g"), F.col(order).alias("o"), safe.alias("safe"), F.when(safe, whole).otherwise(t.safe_path(whole)).alias("c"))
    to = f"{shared_folder(spark)}/names-{uuid.uuid4().hex}"
    rows.write.parquet(to)
    rows = spark.read.schema(rows.schema).parquet(to)
    kept = rows.where("safe").select("g", "p", "c", F.lit(1).cast("long").alias("at"))
    loose = rows.where("not safe").select("id", "g", "o", "p", "c").withColumn("root", root(F.col("c")))
    roots = loose.groupBy("g", "root").agg((F.min("c") == F.max("c")).alias("alone"))
    taken = kept.select("g", F.col("c").alias("x"), root(F.col("c")).alias("root"))
    same = lambda a, b, keys: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    loose = loose.alias("l").join(roots.alias("r"), same("l", "r", ("g", "root"))).select("l.*", "alone")
    taken = taken.alias("t").join(roots.alias("r"), same("t", "r", ("g", "root"))).select("t.*", "alone")

    # one candidate a root: places by number, and by the places that are taken
    held = taken.where("alone").select("g", F.explode(F.array(F.struct(F.col("x").alias("c"), F.lit(1).alias("at")), F.struct(parent(F.col("x")).alias("c"), place(F.col("x")).alias("at")))).alias("y")).select("g", "y.c", "y.at").distinct()
    gaps = held.withColumn("i", F.row_number().over(Window.partitionBy("g", "c").orderBy("at"))).groupBy("g", "c").agg(F.collect_list(F.col("at") - F.col("i")).alias("gaps"))
    one = segments.running(loose.where("alone").withColumn("n", F.lit(1)), ["g", "c"], "o", {"j": "n"})
    one = one.alias("l").join(gaps.alias("h"), same("l", "h", ("g", "c")), "left").select("l.p", "l.c", "l.j", "h.gaps")
    behind = F.coalesce(F.size(F.filter("gaps", lambda x: x <= F.col("j"))), F.lit(0))
    one = one.select("p", "c", (F.col("j") + 1 + F.when(F.col("gaps").isNull(), 0).otherwise(behind)).alias("at"))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        used = set(frame.loc[frame.id < 0, "c"])
        mine = frame[frame.id >= 0].sort_values("o")
        return pd.DataFrame({"id": mine.id, "name": [first_free(c, used) for c in mine.c]})

    both = loose.where("not alone").select("g", "root", "o", "id", "c").unionByName(taken.where("not alone").select("g", "root", F.lit(0).cast(kinds["o"]).alias("o"), F.lit(-1).cast("long").alias("id"), F.col("x").alias("c")))
    several = both.groupBy("g", "root").applyInPandas(settle, "id long, name string")
    several = loose.where("not alone").join(several, "id").select("p", F.col("name").alias("c"), F.lit(1).cast("long").alias("at"))
    named = kept.drop("g").unionByName(one).unionByName(several).select("p.*", F.col("c").alias("_c"), F.col("at").alias("_at"))
    named = named if made is None else named.repartition(parts, group, order)
    return named.select(group, order, whole.alias(path), chained(F.col("_c"), F.col("_at")).alias("new_path"))


def first_free(name: str, used: set[str]) -> str:
    """The first name of the chain that is not used, which it is from now on."""
    n = 2
    while name in used:
        dot = name.rfind(".")
        base, ext = (name[:dot], name[dot:]) if dot > 0 else (name, "")
        name, n = f"{base}-{n}{ext}", n + 1
    used.add(name)
    return name
