"""Problem 2: records that share most of their words, by the signature-coordinate join of ``near``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import near
from skein.llm.records import in_classes, salt_join, texts
from skein.session import Written

KEY = ["k_hi", "k_lo"]


def class_pairs(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs with the copy-key digests and row counts of both classes, the smaller class as x."""
    met = near.among(classes.select("t", "id", "n", *KEY), pairs)
    a, b = (met.select("t", F.col("id").alias(f"id_{c}"), F.struct("n", "id", *KEY).alias(c)) for c in "ab")
    both = pairs.select("t", "id_a", "id_b").join(a, ["t", "id_a"]).join(b, ["t", "id_b"])
    x, y = F.least("a", "b"), F.greatest("a", "b")
    return both.select(
        F.when(F.col("t") == 1, "train").otherwise("prompts").alias("tab"), x.k_hi.alias("x_hi"), x.k_lo.alias("x_lo"), x.n.alias("n_x"), y.k_hi.alias("y_hi"), y.k_lo.alias("y_lo"), y.n.alias("n_y")
    )


def expand(members: DataFrame, pairs: DataFrame, total: int) -> DataFrame:
    """(tab, x, y[, held of both]): all rows of the classes of each pair, hot classes salted."""
    left = in_classes(members, pairs, "x").withColumnsRenamed({"id": "x", "k_hi": "x_hi", "k_lo": "x_lo", "held": "held_x"})
    right = in_classes(members, pairs, "y").withColumnsRenamed({"id": "y", "k_hi": "y_hi", "k_lo": "y_lo", "held": "held_y"})
    first = salt_join(left, pairs, ["tab", "x_hi", "x_lo"], "x", "n_x", total)
    return salt_join(right, first, ["tab", "y_hi", "y_lo"], "y", "n_y", total, counts=pairs)


def shaped_tables(rows: DataFrame, out: Written) -> tuple[DataFrame, DataFrame]:
    """(members without words, classes with words), both written."""
    shaped = out.table(near.shape(rows), "shaped")
    classes = out.table(near.classes_of(shaped), "classes")
    members = out.table(shaped.drop("words"), "members")
    out.drop("shaped")
    return members, classes


def near_copies(rows: DataFrame, num: int = 7, den: int = 10, hot: int = near.HOT) -> DataFrame:
    """Pairs (tab, id_a, id_b) of rows of one tab that are no copies and share num/den of their words or more.

    Null texts and texts without letter or digit are in no pair. All rows of near classes are paired.
    """
    out = Written(rows.sparkSession, "p2")
    members, classes = shaped_tables(rows, out)
    links = out.table(near.near_classes(classes, out, num, den, hot=hot), "links")
    pairs = out.table(class_pairs(classes, links), "pairs")
    out.keep("members", "pairs")
    got = expand(members.drop("held"), pairs, members.count())
    return got.select("tab", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(texts(spark, sf_dir).withColumn("held", F.lit(False)))


def group_labels(nodes: DataFrame, links: DataFrame, out: Written) -> DataFrame:
    """(t, id, group): the smallest id of each node's component, nodes (t, id), links (t, id_a, id_b).

    Stars are drawn by turns: each node hangs its larger neighbours, then its smaller ones, on the smallest neighbour it has, until every link
    leads to its component's smallest id. Each turn is a written table with at most one row a link; only its fingerprint comes to the driver.
    """
    edges, before, at = links.select("t", F.col("id_a").alias("u"), F.col("id_b").alias("v")), None, 0
    while True:
        both = edges.unionByName(edges.select("t", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("t", "u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, ["t", "u"]).where("v <> m").select("t", F.col("m").alias("u"), "v")
        down = F.struct(F.least("u", "v").alias("s"), F.greatest("u", "v").alias("b"))
        large = large.select("t", down.alias("e")).distinct().select("t", F.col("e.b").alias("u"), F.col("e.s").alias("v"))
        least = large.groupBy("t", "u").agg(F.min("v").alias("m"))
        small = large.join(least, ["t", "u"])
        hung = small.select("t", F.col("u").alias("x"), "m").unionByName(small.select("t", F.col("v").alias("x"), "m"))
        edges = out.table(hung.where("x <> m").distinct().select("t", F.col("m").alias("u"), F.col("x").alias("v")), f"stars_{at}")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("t", "u", "v").cast("decimal(38,0)"))).first())
        if at:
            out.drop(f"stars_{at - 1}")
        if now == before:
            break
        before, at = now, at + 1
    label = edges.groupBy("t", F.col("v").alias("id")).agg(F.min("u").alias("group"))
    return nodes.select("t", "id").join(label, ["t", "id"], "left").select("t", "id", F.coalesce("group", "id").alias("group"))


def near_groups(rows: DataFrame, num: int = 7, den: int = 10, hot: int = near.HOT) -> DataFrame:
    """(tab, id, class_id, group_id, links): each row's class of copies, its group and the number of links of its class.

    ``class_id`` is the smallest id of the row's copies, ``group_id`` the smallest one of all classes that near links lead to, near by near;
    links are those between classes. Null texts and texts without letter or digit have no row; a repeated id has one for each of its rows.
    """
    out = Written(rows.sparkSession, "p2")
    members, classes = shaped_tables(rows, out)
    links = out.table(near.near_classes(classes, out, num, den, hot=hot).select("t", "id_a", "id_b"), "links")
    labels = group_labels(classes, links, out)
    n = links.select("t", F.explode(F.array("id_a", "id_b")).alias("id")).groupBy("t", "id").agg(F.count("*").alias("links"))
    of = classes.select("t", "id", "n", *KEY).join(labels, ["t", "id"]).join(n, ["t", "id"], "left").select(
        F.when(F.col("t") == 1, "train").otherwise("prompts").alias("tab"), *KEY, F.col("id").alias("class_id"), F.col("group").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"), "n"
    )
    of = out.table(of, "of_class")
    out.keep("members", "of_class")
    return salt_join(members.drop("held"), of, ["tab", *KEY], "id", "n", members.count()).select("tab", "id", "class_id", "group_id", "links")


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(texts(spark, sf_dir).withColumn("held", F.lit(False)))


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}
