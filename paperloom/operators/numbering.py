"""Repair of numbered lists that a conversion has parted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def signature(xml: Column) -> Column:
    """A level's definition as text: white space between tags and around it is left out."""
    return F.trim(F.regexp_replace(xml, ">\\s+<", "><"))


def numbered(paragraphs: DataFrame, nums: DataFrame, levels: DataFrame, overrides: DataFrame) -> DataFrame:
    """Paragraphs (doc_id, seq, num_id, level) with the signature and restart that a document's numbering says.

    nums: doc_id, num_id, abstract_id; levels: doc_id, abstract_id, level, xml; overrides: doc_id, num_id, level,
    start. A blank level is "0". Without a definition of its level a paragraph has no signature and isn't numbered;
    restart: an override lets the number's level start at 1.
    """
    level = F.when(F.coalesce(F.trim("level"), F.lit("")) == "", "0").otherwise(F.col("level").cast("string")).alias("level")
    some = paragraphs.select("doc_id", "seq", "num_id", level)
    number = F.col("num_id").try_cast(paragraphs.schema["num_id"].dataType).alias("num_id")
    known = nums.select("doc_id", number, "abstract_id").where("num_id IS NOT NULL").groupBy("doc_id", "num_id").agg(F.max("abstract_id").alias("a"))
    named = F.col("level").cast("string").alias("level")
    forms = levels.select("doc_id", "abstract_id", named, "xml").where("abstract_id IS NOT NULL AND level IS NOT NULL").groupBy("doc_id", "abstract_id", "level").agg(F.max(signature(F.col("xml"))).alias("s"))
    ones = overrides.where(F.col("start") == 1).select("doc_id", number, named).where("num_id IS NOT NULL AND level IS NOT NULL")
    # what a document defines is a row of it: one join by document in place of one for each kind of definition
    of_doc = lambda df, key, value: df.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(key, value))))
    known = of_doc(known, "num_id", "a").toDF("doc_id", "_known")
    forms = of_doc(forms, F.struct("abstract_id", "level").alias("k"), "s").toDF("doc_id", "_forms")
    ones = ones.groupBy("doc_id").agg(F.collect_set(F.struct("num_id", "level")).alias("_ones"))
    out = some.join(known, "doc_id", "left").join(forms, "doc_id", "left").join(ones, "doc_id", "left")
    abstract = F.try_element_at("_known", F.col("num_id"))
    form = F.try_element_at("_forms", F.when(abstract.isNotNull(), F.struct(abstract.alias("abstract_id"), F.col("level"))))
    restart = F.array_contains("_ones", F.when(F.col("num_id").isNotNull(), F.struct("num_id", "level")))
    return out.select("doc_id", "seq", "num_id", "level", form.alias("signature"), F.coalesce(restart, F.lit(False)).alias("restart"))


def repaired_lists(paragraphs: DataFrame) -> DataFrame:
    """doc_id, seq, num_id, fixed_num_id of paragraphs (doc_id, seq, num_id, level, signature, restart), in order of seq.

    A list that restarts at its first paragraph takes over the paragraphs that follow it under other numbers used before,
    as long as level and signature agree; paragraphs without number or signature, and the list's own number, end that.
    The number taken over counts for the next paragraph: all up to the end get the restarted list's number.

    The first paragraph of a restarting list begins a run, and a paragraph that can't be taken over ends it, so that the
    repair is a running count of ends within runs; no document is gathered.
    """
    order = Window.partitionBy("doc_id").orderBy("seq")
    has = F.col("num_id").isNotNull() & (F.trim(F.col("num_id").cast("string")) != "") & F.col("signature").isNotNull()
    rows = paragraphs.select("doc_id", "seq", "num_id", F.coalesce(F.col("level").cast("string"), F.lit("")).alias("_level"), signature(F.col("signature")).alias("signature"), "restart").withColumn("_has", has)
    first = Window.partitionBy("doc_id", "num_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_seen", F.col("_has") & (F.coalesce(F.sum(F.col("_has").cast("int")).over(first), F.lit(0)) > 0))
    head = F.when(F.col("_has") & ~F.col("_seen") & F.coalesce("restart", F.lit(False)), F.struct("seq", "num_id", "_level", "signature"))
    rows = rows.withColumn("_head", F.last(head, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_own", head.isNotNull())
    goes = F.col("_seen") & (F.col("_level") == F.col("_head._level")) & (F.col("signature") == F.col("_head.signature")) & (F.col("num_id") != F.col("_head.num_id"))
    rows = rows.withColumn("_ends", (~F.coalesce(goes, F.lit(False))).cast("int"))
    run = Window.partitionBy("doc_id", "_head.seq").orderBy("seq")
    taken = F.col("_head").isNotNull() & (F.sum("_ends").over(run) == 0)
    return rows.select("doc_id", "seq", "num_id", F.when(taken, F.col("_head.num_id")).otherwise(F.when(F.col("_has"), F.col("num_id"))).alias("fixed_num_id"))
