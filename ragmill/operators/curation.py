"""Building training rows: seeded sampling, negatives, gold placement, conversation conversion.

Every sampler orders by a seeded hash of stable ids, so a sample is the same on any cluster and in any engine. Where a
window ranks candidates it does so within a question, whose list is bounded by the retriever's depth.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import swap
from ..functions.base import seeded, seeded_int
from ..functions.text import base_document_id, evidence_list, fill
from . import ranges

# Filters and projections


def keep_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Those of the columns that are there, in this order."""
    return df.select(*[c for c in columns if c in df.columns])


def optional_in(df: DataFrame, **wanted: Sequence) -> DataFrame:
    """Rows whose columns are among the wanted values; an empty list is no filter, a scalar is a list of one."""
    for name, values in wanted.items():
        values = [values] if isinstance(values, str | int | float) else list(values)
        if values:
            df = df.where(F.col(name).isin(values))
    return df


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows for a list of ids, an id's row as often as the id is listed."""
    return ids.select(key).join(df, key)


def within_budget(df: DataFrame, length: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows of at most so many tokens, and one row with n, n_dropped and percent_dropped."""
    over = F.count_if(F.col(length) > most)
    return df.where(F.col(length) <= most), df.agg(F.count(F.lit(1)).alias("n"), over.alias("n_dropped"), (100.0 * over / F.count(F.lit(1))).alias("percent_dropped"))


def skip_reason(*rules: tuple[Column, str]) -> Column:
    """Name of the first rule that holds, null if none: why a row is left out."""
    out = F.lit(None).cast("string")
    for condition, reason in reversed(rules):
        out = F.when(condition, F.lit(reason)).otherwise(out)
    return out


def alternating(messages: Column) -> Column:
    """User first, then strictly in turn."""
    wrong = F.filter(messages, lambda m, i: m["role"] != F.when(i % 2 == 0, "user").otherwise("assistant"))
    return (F.size(messages) > 0) & (F.size(wrong) == 0)


def well_formed(prompt: Column, response: Column, *, pairs: bool = False, passages: Column | None = None) -> Column:
    """An odd number of prompt turns, and one response (two or more for pairs); ensembles need passages too."""
    ok = (F.size(prompt) % 2 == 1) & ((F.size(response) >= 2) if pairs else (F.size(response) == 1))
    return ok & (F.size(passages) > 0) if passages is not None else ok


def with_metric(df: DataFrame, metric: str) -> tuple[DataFrame, DataFrame]:
    """Rows that have a metric, and one row with n_skipped, how many have none."""
    return df.where(F.col(metric).isNotNull()), df.agg(F.count_if(F.col(metric).isNull()).alias("n_skipped"))


def without_images(df: DataFrame, column: str = "images") -> tuple[DataFrame, DataFrame]:
    """The array column emptied, and how many rows that changed."""
    empty = F.slice(F.col(column), 1, 0)
    return df.withColumn(column, empty), df.agg(F.count_if(F.size(column) > 0).alias("n_modified"))


def with_prompt(df: DataFrame, template: str, *, question: str, passages: str, top_k: int | None = None, start: str = "", end: str = "", name: str = "prompt") -> DataFrame:
    """Adds a prompt: the template filled with the question and the first passages (passage_id, text) as evidence, in rank order."""
    shown = F.slice(passages, 1, top_k) if top_k else F.col(passages)
    return df.withColumn(name, fill(template, question=F.col(question), evidence=evidence_list(shown, start, end)))


#: Columns of each training mode: name in the examples -> source.
MODES = {
    "sft": {"answer_input": "prompt", "answer_target": "chosen"},
    "dpo": {"answer_input": "prompt", "chosen_answer_target": "chosen", "rejected_answer_target": "rejected"},
    "attn_sft": {"answer_input": "prompt", "answer_target": "chosen", "gt_evidence_labels": "gt_evidence_labels"},
}


def mode_rows(df: DataFrame, mode: str) -> DataFrame:
    """The columns that a training mode reads, under its names; columns that no mode reads stay."""
    if mode not in MODES:
        raise ValueError(f"no mode {mode}; there are {', '.join(MODES)}")
    sources = {c for m in MODES.values() for c in m.values()}
    return df.select(*[c for c in df.columns if c not in sources], *[F.col(c).alias(name) for name, c in MODES[mode].items()])


def exported(df: DataFrame, mode: str, name: str = "row") -> DataFrame:
    """Adds a row of the shared JSON format: messages for sft and attn_sft, a conversation with chosen and rejected answers for dpo."""
    ask = F.concat(F.lit("<image> "), "answer_input")
    turn = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    parts = [F.array("img_path").alias("images")] + ([F.col("gt_evidence_labels")] if "gt_evidence_labels" in df.columns else [])
    if mode == "dpo":
        body = [F.array(turn("human", ask)).alias("conversations"), turn("gpt", F.col("chosen_answer_target")).alias("chosen"), turn("gpt", F.col("rejected_answer_target")).alias("rejected")]
    else:
        say = lambda who, text: F.struct(text.alias("content"), F.lit(who).alias("role"))
        body = [F.array(say("user", ask), say("assistant", F.concat(F.lit("[ANSWER] "), "answer_target"))).alias("messages")]
    return df.withColumn(name, F.to_json(F.struct(*body, *parts)))


def natural_order(chunk_id: Column) -> list[Column]:
    """Sort keys of chunk ids: the document, the number at the end (ids without one first), the id."""
    number = F.nullif(F.regexp_extract(chunk_id, r"_(\d+)$", 1), F.lit("")).try_cast("bigint")
    return [base_document_id(chunk_id), F.coalesce(number, F.lit(-1)), chunk_id]


def length_order(length: Column) -> list[Column]:
    """Sort keys of lengths as text: numbers by value, then the rest as text."""
    n = length.try_cast("bigint")
    return [n.isNull(), n, length]


def queue_order(df: DataFrame, by: Sequence[str], *, arrival: str, tie: str, priority: str | None = None) -> DataFrame:
    """turn: the order in which each queue serves its requests, by priority (least first) and arrival, or by arrival alone. A queue may hold
    any number of requests."""
    keys = ([priority] if priority else []) + [arrival, tie]
    return ranges.places(df, by, *[F.col(c) for c in keys], name="turn").withColumn("turn", F.col("turn") + 1)


# Sampling


def sample(df: DataFrame, n: int, key: str, seed: int, offset: int = 0) -> DataFrame:
    """n rows without replacement in seeded order, after an offset. The limit is the feature."""
    out = df.orderBy(seeded(seed, F.col(key)), key)
    return (out.offset(offset) if offset else out).limit(n)


def resample(df: DataFrame, n: int, total: int, row_id: str, seed: int) -> DataFrame:
    """n rows with replacement: slot i takes row hash(i) mod total; row ids run gapless from 0."""
    slots = df.sparkSession.range(n).select(F.col("id").alias("slot"))
    return slots.withColumn(row_id, F.pmod(seeded_int(seed, F.col("slot")), F.lit(total))).join(df, row_id)


def per_group(df: DataFrame, by: Sequence[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each group in an order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def pick(array: Column, seed: int, key: Column) -> Column:
    """One element by seeded hash, null of an empty array."""
    return F.when(F.size(array) > 0, F.get(array, F.pmod(seeded_int(seed, key), F.size(array)).cast("int")))


def negative(candidates: Column, gold: Column, seed: int, key: Column, depth: int = 50) -> Column:
    """Of the first `depth` candidate ids one that isn't gold, by seeded hash; null if all are."""
    others = F.filter(F.slice(candidates, 1, depth), lambda c: ~F.array_contains(gold, c))
    keyed = F.transform(others, lambda c: F.struct(seeded(seed, key, c).alias("h"), c.alias("c")))
    return F.array_min(keyed)["c"]


def balanced_passages(rows: DataFrame, n: int, seed: int, *, question: str = "question_id", quotas: dict[str, int] | None = None) -> DataFrame:
    """n passages a question: gold first, then each kind up to its quota, then the rest, all by seeded hash; slot is the seeded
    order of what was chosen, from 0. rows: question, quote_id, kind, is_gold."""
    h = seeded(seed, F.col(question), F.col("quote_id"))
    kind = F.row_number().over(Window.partitionBy(question, "kind").orderBy(F.col("is_gold").desc(), h, "quote_id"))
    quota = F.lit(n)
    for k, q in (quotas or {}).items():
        quota = F.when(F.col("kind") == k, F.lit(q)).otherwise(quota)
    ranked = rows.withColumn("__over", (kind > quota).cast("int")).withColumn("__h", h)
    place = F.row_number().over(Window.partitionBy(question).orderBy(F.col("is_gold").desc(), "__over", "__h", "quote_id"))
    chosen = ranked.withColumn("__r", place).where(F.col("__r") <= n)
    slot = F.row_number().over(Window.partitionBy(question).orderBy(seeded(seed + 1, F.col(question), F.col("quote_id")), "quote_id"))
    return chosen.withColumn("slot", slot - 1).drop("__over", "__h", "__r")


def with_needle(rows: DataFrame, k: int, seed: int, *, example: str, item: str, position: str, is_needle: str) -> DataFrame:
    """k items of each example, its needle among them, in their first order: index from 0."""
    first = F.row_number().over(Window.partitionBy(example).orderBy(F.col(is_needle).desc(), seeded(seed, F.col(example), F.col(item)), position))
    chosen = rows.withColumn("__r", first).where(F.col("__r") <= k).drop("__r")
    return chosen.withColumn("index", F.row_number().over(Window.partitionBy(example).orderBy(position)) - 1)


def gold_pool(df: DataFrame, ids: str, gold_rank: str, depth: int = 20) -> DataFrame:
    """Questions with a list of at least so many passages, the gold one among the first so many."""
    return df.where((F.size(ids) >= depth) & F.col(gold_rank).between(1, depth))


#: Rank bins that gold passages are moved to.
BINS = ((1, 1), (2, 5), (6, 10), (11, 15), (16, 20))


def gold_placed(lists: Column, gold_rank: Column, low: int, high: int, seed: int, key: Column) -> Column:
    """The list with its gold passage swapped to a seeded rank of a bin, unchanged if it is in the bin already."""
    target = F.lit(low) + F.pmod(seeded_int(seed, key, F.lit(low)), F.lit(high - low + 1))
    return F.when(gold_rank.between(low, high), lists).otherwise(swap(lists, gold_rank - 1, (target - 1).cast("int")))


def nested_prefix(rows: DataFrame, k_values: Sequence[int], seed: int, *, example: str = "example_id", chunk: str = "chunk_id", window: int = 50) -> DataFrame:
    """max(k) chunks an example, any smaller k of which is a prefix with the gold chunk in it.

    rows: example, chunk, is_gold, same_document, chunk_order. Siblings of the gold chunk come first in document order, then others
    in seeded order; the gold chunk stands at a seeded place below min(window, min(k)). Examples with too few chunks go.
    """
    most, least = max(k_values), min(k_values)
    tier = F.when(F.col("same_document"), 0).otherwise(1)
    h = F.when(F.col("same_document"), F.lit("")).otherwise(seeded(seed, F.col(example), F.col(chunk)))
    others = rows.where(~F.col("is_gold")).withColumn("__p", F.row_number().over(Window.partitionBy(example).orderBy(tier, h, "chunk_order", chunk)) - 1)
    gold = rows.where("is_gold").withColumn("__g", F.pmod(seeded_int(seed, F.col(example), F.lit("gold")), F.lit(min(window, least))))
    places = gold.select(example, "__g")
    moved = others.where(F.col("__p") < most).join(places, example).withColumn("position", F.col("__p") + F.when(F.col("__p") >= F.col("__g"), 1).otherwise(0))
    both = moved.select(example, chunk, "is_gold", "position").unionByName(gold.select(example, chunk, "is_gold", F.col("__g").alias("position"))).where(F.col("position") < most)
    return both.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(example))).where(F.col("__n") == most).drop("__n")


def few_shot(targets: DataFrame, pool: DataFrame, n: int, seed: int, *, key: str, pool_key: str, by: str) -> DataFrame:
    """For each target up to n other examples of its own group from a pool; shot counts from 1.

    A group's pool is shuffled by seed, and a target takes those that follow a seeded place of it, around the end: n + 1 places are looked
    at, one of which may be the target itself, whatever the group's size.
    """
    own = pool.select(F.col(pool_key).alias("shot_id"), by).withColumn("__h", seeded(seed, F.col("shot_id")))
    placed = ranges.places(own, [by], F.col("__h"), F.col("shot_id"), name="__i").drop("__h")
    sizes = placed.groupBy(by).agg(F.count(F.lit(1)).alias("__m"))
    start = F.pmod(seeded_int(seed, F.col("target_id"), F.lit("start")), F.col("__m"))
    asked = targets.select(F.col(key).alias("target_id"), by).join(sizes, by).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(n), F.col("__m") - 1))))
    met = asked.withColumn("__i", F.pmod(start + F.col("__k"), F.col("__m"))).join(placed, [by, "__i"]).where(F.col("target_id") != F.col("shot_id"))
    shot = F.row_number().over(Window.partitionBy("target_id").orderBy("__k"))  # n + 1 rows at most
    return met.withColumn("shot", shot).where(F.col("shot") <= n).drop("__m", "__k", "__i")


def uniform_length(mean: int, ratio: float, seed: int, key: Column, least: int = 1) -> Column:
    """A seeded whole number in [floor(m (1 - r)), ceil(m (1 + r))], at least 1."""
    import math

    low, high = max(least, math.floor(mean * (1 - ratio))), max(least, math.ceil(mean * (1 + ratio)))
    return (F.lit(low) + F.pmod(seeded_int(seed, key), F.lit(high - low + 1))).cast("int")


# Training rows


def verification_rows(df: DataFrame, question: str, positive: str, negative_: str) -> DataFrame:
    """Two rows a question: its gold passage with answer yes, another with no."""
    pair = F.array(F.struct(F.col(positive).alias("passage"), F.lit("yes").alias("answer")), F.struct(F.col(negative_).alias("passage"), F.lit("no").alias("answer")))
    return df.select(question, F.explode(pair).alias("__x")).select(question, "__x.*")


def preferences_to_binary(df: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Two rows a preference pair: response and tag."""
    rest = [c for c in df.columns if c not in (chosen, rejected)]
    pair = F.array(F.struct(F.col(chosen).alias("response"), F.lit(True).alias("tag")), F.struct(F.col(rejected).alias("response"), F.lit(False).alias("tag")))
    return df.select(*rest, F.explode(pair).alias("__x")).select(*rest, "__x.*")


def _message(role: Column | str, text: Column, weight: float | Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    weight = F.lit(weight) if isinstance(weight, int | float) else weight
    return F.struct(role.alias("role"), F.array(F.struct(F.lit("text").alias("type"), text.alias("value"))).alias("content"), weight.cast("double").alias("loss_weight"))


def from_alpaca(instruction: Column, inputs: Column, output: Column, system: Column | None = None) -> Column:
    """Canonical messages of an instruction row; only the output carries loss."""
    user = F.concat(instruction, F.coalesce(F.when(inputs != "", F.concat(F.lit("\n"), inputs)), F.lit("")))
    turns = F.array(_message("user", user, 0.0), _message("assistant", output, 1.0))
    if system is None:
        return turns
    return F.when(F.coalesce(system, F.lit("")) != "", F.concat(F.array(_message("system", system, 0.0)), turns)).otherwise(turns)


#: Speakers of shared conversations and the roles they stand for.
ROLES = {"human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "bing": "assistant", "chatgpt": "assistant", "bard": "assistant", "system": "system", "observation": "tool", "function_call": "assistant"}


def from_shared(conversation: Column) -> Column:
    """Canonical messages of (from, value) turns; unknown speakers go, and only the assistant carries loss."""
    table = F.create_map(*[F.lit(x) for p in ROLES.items() for x in p])
    known = F.filter(conversation, lambda t: F.map_contains_key(table, t["from"]))

    def turn(t: Column) -> Column:
        role = F.try_element_at(table, t["from"])
        return _message(role, t["value"], F.when(role == "assistant", 1.0).otherwise(0.0))

    return F.transform(known, turn)


def from_pair(prompt: Column, chosen: Column, rejected: Column) -> Column:
    """chosen and rejected: canonical messages of a prompt's turns with one answer and with the other ((from, value) each)."""
    return F.struct(from_shared(F.concat(prompt, F.array(chosen))).alias("chosen"), from_shared(F.concat(prompt, F.array(rejected))).alias("rejected"))


def tool_call(text: Column) -> Column:
    """name and arguments (JSON) of a function call; null for a text that is none."""
    call = F.from_json(text, "struct<name:string,arguments:string>")
    return F.when(call["name"].isNotNull(), call)


def openai_messages(conversation: Column, max_turns: int | None = None) -> Column:
    """(role, content) turns from the first user turn on, at most so many."""
    table = F.create_map(*[F.lit(x) for p in ROLES.items() for x in p])
    turns = F.transform(conversation, lambda t: F.struct(F.try_element_at(table, t["from"]).alias("role"), t["value"].alias("content")))
    first = F.array_position(F.transform(turns, lambda t: F.coalesce(t["role"], F.lit(""))), "user")
    out = F.when(first > 0, F.slice(turns, first.cast("int"), F.greatest(F.size(turns), F.lit(1)))).otherwise(F.slice(turns, 1, 0))
    return F.slice(out, 1, max_turns) if max_turns else out


def join_parts(parts: Column) -> Column:
    """Parts of a conversation (arrays of turns with a role) as one; a part's first turn goes if its speaker spoke last."""

    def add(seen: Column, part: Column) -> Column:
        again = (F.size(seen) > 0) & (F.size(part) > 0) & (F.get(seen, F.size(seen) - 1)["role"] == F.get(part, 0)["role"])
        return F.concat(seen, F.when(F.coalesce(again, F.lit(False)), F.slice(part, 2, F.greatest(F.size(part), F.lit(1)))).otherwise(part))

    return F.aggregate(parts, F.slice(F.flatten(parts), 1, 0), add)


def chat_text(messages: Column, start: str = "<|im_start|>", end: str = "<|im_end|>") -> Column:
    """(role, content) turns in a chat template."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit(start), m["role"], F.lit("\n"), m["content"], F.lit(f"{end}\n"))), "")


def multiple_choice(question: Column, choices: Column, answer: Column | None = None) -> Column:
    """A question with lettered choices and, for shots, its answer."""
    letters = F.array(*[F.lit(c) for c in "ABCDEFGHIJ"])
    lines = F.array_join(F.transform(choices, lambda c, i: F.concat(F.lit("\n"), F.get(letters, i), F.lit(". "), c)), "")
    return F.concat(question, lines, F.lit("\nAnswer:"), F.coalesce(answer, F.lit("")) if answer is not None else F.lit(""))


def ensemble_rows(df: DataFrame, passages: str, gold: str, *, keep: Sequence[str]) -> DataFrame:
    """A row for each passage of a question: branch from 0, and whether its index is among the gold ones."""
    return df.select(*keep, gold, F.posexplode(passages).alias("branch", "passage")).withColumn("is_gold", F.array_contains(gold, F.col("branch"))).drop(gold)


def selected_documents(passages: Column, k: int, most_words: int | None = None) -> Column:
    """The first k passages, texts cut to so many words; for k = 0 one empty document."""
    from ..functions.text import truncate_words_anywhere

    if k == 0:
        return F.array(F.struct(F.lit("empty_document").alias("passage_id"), F.lit("").alias("text")))
    cut = (lambda t: truncate_words_anywhere(t, most_words)) if most_words else (lambda t: t)
    return F.transform(F.slice(passages, 1, k), lambda p: F.struct(p["passage_id"].alias("passage_id"), cut(p["text"]).alias("text")))


def transition(responses: Column, limit: int = 6) -> Column:
    """Whether a dialogue has ended: an answer has been given, or so many steps have been taken."""
    return F.exists(responses, lambda r: F.contains(r, F.lit("[ANSWER]"))) | (F.size(responses) >= limit)


def image_tokens(width: Column, height: Column, *, patch: int = 14, merge: int = 2, min_pixels: int = 3136, max_pixels: int = 1003520) -> Column:
    """Tokens of an image scaled into pixel limits: (h // p) (w // p) // m^2, at least 1."""
    area = width * height
    scale = F.when(area > max_pixels, F.sqrt(F.lit(max_pixels) / area)).when(area < min_pixels, F.sqrt(F.lit(min_pixels) / area)).otherwise(F.lit(1.0))
    w, h = F.bround(width * scale), F.bround(height * scale)
    return F.greatest(F.floor(F.floor(h / patch) * F.floor(w / patch) / (merge * merge)), F.lit(1)).cast("int")
