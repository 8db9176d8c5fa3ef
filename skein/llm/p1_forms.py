"""Problem 1: texts that look the same but are stored with different characters."""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import forms
from skein.llm.records import all_texts, digest_columns, identified, map_batches, salt_join, texts
from skein.session import Written

FORM = ["tab", "f_hi", "f_lo"]


def with_form(rows: DataFrame) -> DataFrame:
    """(tab, id, form): the visible form of each text.

    Null texts have a null form, texts that show nothing the form ''. Other columns are not looked at.
    """

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        form = [forms.visible_form(x) for x in b.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("tab"), b.column("id"), pa.array(form, pa.string())], ["tab", "id", "form"])

    return map_batches(rows.select("tab", "id", "text"), one, "tab string, id bigint, form string")


def form_digests(rows: DataFrame) -> DataFrame:
    """(tab, id, f_hi, f_lo, t): digests of the visible form (128 bits) and of the stored text (64 bits).

    Rows whose text is null or shows nothing, and rows without id or tab, are left out. Two stored texts are told apart by 64 bits
    only within one form, so a chance match needs two variants of the same form.
    """

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        form_d, text_d, keep = [], [], []
        for i, x in enumerate(b.column("text").to_pylist()):
            form = forms.visible_form(x)
            if form:
                keep.append(i)
                form_d.append(xxhash.xxh3_128_digest(form.encode("utf-8", "surrogatepass")))
                text_d.append(xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63))
        hi, lo = digest_columns(form_d)
        kept = pa.array(keep, pa.int32())
        return pa.RecordBatch.from_arrays([b.column("tab").take(kept), b.column("id").take(kept), hi, lo, pa.array(text_d, pa.int64())], ["tab", "id", "f_hi", "f_lo", "t"])

    return map_batches(identified(rows).select("tab", "id", "text"), one, "tab string, id bigint, f_hi bigint, f_lo bigint, t bigint")


#: Variants of a form in a block.
BLOCK = 200


def _variant_pairs(v: DataFrame, block: int = BLOCK) -> DataFrame:
    """(form, t_a, n_a, t_b, n_b) of each two variants of a form, a the rarer; v is (form, t, n).

    The variants of a form fall into blocks by their digest; each pair of blocks is a task's share of its own, to which a variant is copied
    once for each block of its form, so no task holds more than two blocks.
    """
    of = v.groupBy(*FORM).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = v.join(of, FORM).withColumn("own", F.pmod(F.xxhash64("t"), F.col("blocks")).cast("int"))
    each = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at = (F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    a = each.select(*FORM, *at, F.col("own").alias("o_a"), F.col("t").alias("t_a"), F.col("n").alias("n_a"))
    b = each.select(*FORM, *at, F.col("own").alias("o_b"), F.col("t").alias("t_b"), F.col("n").alias("n_b"))
    rarer = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("t_a") < F.col("t_b")))
    both = a.join(b, [*FORM, "p", "q"]).where((F.col("t_a") != F.col("t_b")) & rarer)
    # Two variants meet in the pair of their own blocks only.
    return both.where((F.least("o_a", "o_b") == F.col("p")) & (F.greatest("o_a", "o_b") == F.col("q"))).select(*FORM, "t_a", "n_a", "t_b", "n_b")


def look_classes(rows: DataFrame) -> DataFrame:
    """(tab, id, class_id, rows, variants): each row whose text shows something, the smallest id of its visible form, the rows of that form
    and the number of different stored texts among them. Null texts and texts that show nothing have no row.
    """
    out = Written(rows.sparkSession, "p1")
    digests = out.table(form_digests(rows), "digests")
    v = digests.groupBy(*FORM, "t").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    of = out.table(v.groupBy(*FORM).agg(F.min("id").alias("class_id"), F.sum("n").alias("rows"), F.count("*").alias("variants")), "classes")
    return salt_join(digests.drop("t"), of, FORM, "id", "rows", digests.count()).select("tab", "id", "class_id", "rows", "variants")


def same_look(rows: DataFrame) -> DataFrame:
    """Pairs (tab, id_a, id_b), id_a < id_b, of rows of one tab whose texts differ but have one visible form.

    Variants (the different stored texts of a form) are paired first, with their row counts, a form of many variants in blocks; pairs of
    variants are then joined with their rows, the rarer variant first, hot variants salted. Rows with
    equal texts are no pair, repeated ids count once for each row.
    """
    out = Written(rows.sparkSession, "p1")
    digests = out.table(form_digests(rows), "digests")
    forms_ = digests.groupBy(*FORM).agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n"))
    mixed = out.table(forms_.where("t0 <> t1").select(*FORM, "n"), "mixed_forms")
    total = digests.count()
    members = out.table(salt_join(digests, mixed, FORM, "id", "n", total).drop("n"), "members")
    v = members.groupBy(*FORM, "t").agg(F.count("*").alias("n"))
    pairs = out.table(_variant_pairs(v), "pairs")
    out.keep("members", "pairs")
    first = salt_join(members.withColumnsRenamed({"t": "t_a", "id": "x"}), pairs, [*FORM, "t_a"], "x", "n_a", total).select(*FORM, "x", "t_b", "n_b")
    both = salt_join(members.withColumnsRenamed({"t": "t_b", "id": "y"}), first, [*FORM, "t_b"], "y", "n_b", total, counts=pairs)
    return both.select("tab", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_look(texts(spark, sf_dir))


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_form(all_texts(spark, sf_dir))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_classes(texts(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_forms": p1_forms, "p1_classes": p1_classes}
