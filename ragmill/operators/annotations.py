"""Annotated questions: lookups by id, image and type, and the joins that evaluators and training builders feed on.

Annotations are rows of question_id, image_id, question_type, answer_type, answers (array of answer_id, answer) and position, the
annotations' own order. Lists of ids are the caller's and small; they meet the tables as broadcast rows that keep their order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _listed(df: DataFrame, ids: Sequence, column: str) -> DataFrame:
    kind = df.schema[column].dataType.simpleString()
    return F.broadcast(df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], f"listed long, {column} {kind}"))


def _typed(df: DataFrame, question_types: Sequence[str], answer_types: Sequence[str]) -> DataFrame:
    for name, wanted in (("question_type", question_types), ("answer_type", answer_types)):
        if wanted:
            df = df.where(F.col(name).isin([wanted] if isinstance(wanted, str) else list(wanted)))
    return df


def question_ids(annotations: DataFrame, images: Sequence | int = (), question_types: Sequence[str] = (), answer_types: Sequence[str] = ()) -> DataFrame:
    """question_id, listed and position: in the order of the image list, then of the annotations; an image listed twice gives its
    questions twice; an empty list is no filter (listed is then 0)."""
    images = [images] if isinstance(images, int) else list(images)
    found = annotations.join(_listed(annotations, images, "image_id"), "image_id") if images else annotations.withColumn("listed", F.lit(0).cast("long"))
    return _typed(found, question_types, answer_types).select("question_id", "listed", "position")


def last_annotations(annotations: DataFrame) -> DataFrame:
    """One annotation for each question: the last."""
    rest = [c for c in annotations.columns if c != "question_id"]
    return annotations.groupBy("question_id").agg(F.max_by(F.struct(*rest), "position").alias("a")).select("question_id", "a.*")


def image_ids(annotations: DataFrame, questions: Sequence | int = (), question_types: Sequence[str] = (), answer_types: Sequence[str] = ()) -> DataFrame:
    """image_id, listed and position: the images of listed questions, whose last annotation counts; unknown ids give nothing."""
    questions = [questions] if isinstance(questions, int) else list(questions)
    if questions:
        wanted = _listed(annotations, questions, "question_id")
        found = last_annotations(annotations.join(wanted.select("question_id").distinct(), "question_id", "left_semi")).join(wanted, "question_id")
    else:
        found = annotations.withColumn("listed", F.lit(0).cast("long"))
    return _typed(found, question_types, answer_types).select("image_id", "listed", "position")


def by_image(annotations: DataFrame) -> DataFrame:
    """image_id and its questions in the annotations' order. An image has few."""
    return annotations.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "question_id"))), lambda x: x["question_id"]).alias("question_ids"))


def loaded(annotations: DataFrame, ids: Sequence | int) -> DataFrame:
    """The last annotations of listed questions, with listed; an id that is listed twice comes twice."""
    wanted = _listed(annotations, [ids] if isinstance(ids, int) else list(ids), "question_id")
    return last_annotations(annotations.join(wanted.select("question_id").distinct(), "question_id", "left_semi")).join(wanted, "question_id")


def flat_qa(annotations: DataFrame, questions: DataFrame) -> DataFrame:
    """image_id, question_id, question and answers as a map from answer id to answer, the last of equal ids; a row for each annotation
    whose question is known (question_id, question; of several the last by its position)."""
    known = questions.groupBy("question_id").agg(F.max_by("question", "position").alias("question"))
    pairs = F.filter("answers", lambda a, i: ~F.exists(F.slice("answers", i + 2, F.greatest(F.size("answers"), F.lit(1))), lambda b: b["answer_id"] == a["answer_id"]))
    answers = F.map_from_entries(F.transform(pairs, lambda a: F.struct(a["answer_id"], a["answer"])))
    return annotations.join(known, "question_id").select("image_id", "question_id", "question", answers.alias("answers"), "position")


def gold_documents(questions: DataFrame, passages: DataFrame, *, gold: str = "pos_item_ids") -> DataFrame:
    """question_id and its gold documents (id, content) in the order of their ids; ids that the passages lack are left out, a question
    without any has an empty list. passages: passage_id, passage_content, each id once."""
    at = questions.select("question_id", F.posexplode(gold).alias("place", "passage_id"))
    met = at.join(passages.select("passage_id", "passage_content"), "passage_id")
    lists = met.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("place", F.col("passage_id").alias("id"), F.col("passage_content").alias("content")))).alias("d"))
    documents = F.transform(F.coalesce("d", F.slice("d", 1, 0)), lambda x: F.struct(x["id"], x["content"]))
    empty = F.array().cast("array<struct<id:string,content:string>>")
    return questions.select("question_id").join(lists, "question_id", "left").select("question_id", F.coalesce(documents, empty).alias("documents"))


def with_evidence(rows: DataFrame, evidence: DataFrame, key: str, pages: str = "pages") -> DataFrame:
    """Rows with their evidence pages, an empty list by default, how many, and the group: 0_gt, 1_gt or multi_gt."""
    met = rows.join(evidence.select(key, pages), key, "left").withColumn(pages, F.coalesce(pages, F.array().cast(evidence.schema[pages].dataType.simpleString())))
    n = F.size(pages)
    return met.withColumn("gt_count", n).withColumn("gt_group", F.when(n == 1, "1_gt").when(n >= 2, "multi_gt").otherwise("0_gt"))


def scored_pairs(predictions: DataFrame, references: DataFrame, key: str, score: Column) -> DataFrame:
    """Predictions that have a reference, with a score of both; the others are left out."""
    return predictions.join(references, key).withColumn("score", score)


def judge_report(scored: DataFrame, asked: int | Column) -> DataFrame:
    """Mean score, how many rows have one, and their share of those that were asked for."""
    n = F.lit(asked) if isinstance(asked, int) else asked
    return scored.agg(F.avg("score").alias("mean_score"), F.count("score").alias("n_scored"), F.try_divide(F.count("score"), n).alias("coverage"))


def enriched(results: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """Results with their annotations. Both must have the same ids: a row that one side lacks fails the query."""
    a = annotations.withColumn("__there", F.lit(True))
    met = results.withColumn("__here", F.lit(True)).join(a, key, "full")
    whole = F.col("__here") & F.col("__there")
    lost = F.raise_error(F.concat(F.lit(f"{key} on one side only: "), F.col(key).cast("string")))
    return met.where(F.when(whole, True).otherwise(lost.cast("boolean"))).drop("__here", "__there")


def captions(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """file_name and its first caption, by position; annotations of unknown images are left out. images: id, file_name."""
    named = annotations.join(images, annotations["image_id"] == images["id"])
    return named.groupBy("file_name").agg(F.min_by("caption", "position").alias("caption"))


def siblings(chunks: DataFrame, base: Column, chunk: str = "chunk_id") -> DataFrame:
    """chunk, base and how many chunks of the same document there are."""
    from pyspark.sql import Window

    return chunks.select(chunk, base.alias("base")).withColumn("n_siblings", F.count(F.lit(1)).over(Window.partitionBy("base")))


def first_chunk_with(chunks: Column, needle: Column) -> Column:
    """Index of the first chunk that holds the needle, trimmed; -1 if none does or it is blank."""
    n = F.trim(F.coalesce(needle, F.lit("")))
    at = F.array_min(F.filter(F.transform(chunks, lambda c, i: F.when(F.contains(F.coalesce(c, F.lit("")), n), i)), lambda i: i.isNotNull()))
    return F.when(n == "", F.lit(-1)).otherwise(F.coalesce(at, F.lit(-1)))


def score_pairs(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """Rows that a scorer sees together: one query and its many documents, or as many documents as queries, in order. Columns: order
    and q; order and d. One query is broadcast; other shapes meet by their order, and any but N:N fail."""
    n, m = left.count(), right.count()
    if n == 1:
        return right.join(F.broadcast(left.select("q")))
    if n != m:
        raise ValueError(f"{n} queries for {m} documents")
    return left.join(right, order)


def needle_cells(spark, n: int, positives: int, length: int, grid: int, seed: int) -> DataFrame:
    """id, has_needle, index (of the image), row and col: the first so many examples have their needle in a seeded cell, the others
    nowhere (-1)."""
    from ..functions.base import seeded_int

    cells = grid * grid
    j = F.pmod(seeded_int(seed, F.col("id")), F.lit(length * cells))
    has = F.col("id") < positives
    place = lambda c: F.when(has, c).otherwise(F.lit(-1)).cast("int")
    at = F.pmod(j, F.lit(cells))
    return spark.range(n).select("id", has.alias("has_needle"), place(F.floor(j / cells)).alias("index"), place(F.floor(at / grid)).alias("row"), place(F.pmod(at, F.lit(grid))).alias("col"))


def stitched(spark, n: int, images: DataFrame, image: str, grid: int, seed: int) -> DataFrame:
    """id, cell (r_c) and image: for each of n stitched images grid * grid different ones. images is numbered by row_id, gapless from 0.

    A seeded start and step walk through the numbers below a prime, so none is met twice; as many numbers are walked as are needed
    and lie beyond the table, so enough stay, and no list of images is sorted for a stitch.
    """
    from pyspark.sql import Window

    from ..functions.base import seeded_int

    total, need = images.count(), grid * grid
    if total < need:
        raise ValueError(f"{need} images are needed, there are {total}")
    prime = next(p for p in range(max(total, 2), 2 * total + 3) if all(p % d for d in range(2, int(p**0.5) + 1)))
    run = need + prime - total
    ids = spark.range(n).select("id", F.pmod(seeded_int(seed, F.col("id")), F.lit(prime)).alias("a"), (F.pmod(seeded_int(seed + 1, F.col("id")), F.lit(prime - 1)) + 1).alias("b"))
    walked = ids.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(run - 1)), lambda i: F.pmod(F.col("a") + i * F.col("b"), F.lit(prime)))).alias("step", "row_id"))
    kept = walked.where(F.col("row_id") < total)
    place = F.row_number().over(Window.partitionBy("id").orderBy("step")) - 1
    first = kept.withColumn("place", place).where(F.col("place") < need)
    cell = F.concat(F.floor(F.col("place") / grid).cast("string"), F.lit("_"), F.pmod("place", F.lit(grid)).cast("string"))
    return first.join(images.select("row_id", image), "row_id").select("id", cell.alias("cell"), image)


#: Rows up to which a settings table is broadcast.
FEW = 10_000


def config_matrix(tables: Sequence[DataFrame]) -> DataFrame:
    """A row for each combination of the values of several settings: the cross product is the feature, and its tables are the caller's. A
    table is broadcast if it is counted to be small."""
    out = tables[0]
    for t in tables[1:]:
        out = out.crossJoin(F.broadcast(t) if t.limit(FEW + 1).count() <= FEW else t)
    return out
