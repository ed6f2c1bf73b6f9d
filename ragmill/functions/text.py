"""Text functions for questions, passages and model responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import let

# Words


def words(text: Column) -> Column:
    """Words between runs of Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+", -1), lambda w: w != "")


def count_words(text: Column) -> Column:
    """0 for null and blank texts."""
    return F.coalesce(F.size(words(text)), F.lit(0))


def count_words_by_spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def truncate_words(text: Column, n: int) -> Column:
    """The first n parts between single spaces; empty parts count."""
    return F.array_join(F.slice(F.split(text, " ", -1), 1, n), " ")


def truncate_words_anywhere(text: Column, n: int) -> Column:
    """The first n words, joined by single spaces."""
    return F.array_join(F.slice(words(text), 1, n), " ")


def normalize_space(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def sliding_chunks(text: Column, *, size: int = 512, parts: int | None = None, overlap: int = 100) -> Column:
    """Windows of words that overlap; [''] for a blank text. With parts, the window is the words over parts, rounded up.

    The overlap is at most one less than the window, and every step gives a window, so the last ones may be suffixes.
    """

    def cut(ws: Column) -> Column:
        n = F.size(ws)
        window = F.greatest(F.lit(1), F.ceil(n / F.lit(parts)).cast("int")) if parts else F.lit(max(1, size))
        step = F.greatest(F.lit(1), window - F.least(F.lit(max(0, overlap)), window - 1))
        starts = F.sequence(F.lit(0), n - 1, step)
        return F.when(n > 0, F.transform(starts, lambda i: F.array_join(F.slice(ws, i + 1, window), " "))).otherwise(F.array(F.lit("")))

    return let(words(F.coalesce(text, F.lit(""))), cut)


def overlaps_next(chunks: Column, overlap: int) -> Column:
    """For each pair of neighbours: whether the first's last words are the second's first."""

    def pairs(ws: Column) -> Column:
        def check(i: Column) -> Column:
            a, b = F.get(ws, i), F.get(ws, i + 1)
            return F.slice(a, F.greatest(F.lit(1), F.size(a) - overlap + 1), overlap) == F.slice(b, 1, overlap)

        return F.when(F.size(ws) > 1, F.transform(F.sequence(F.lit(0), F.size(ws) - 2), check)).otherwise(F.array().cast("array<boolean>"))

    return let(F.transform(chunks, words), pairs)


# Templates and evidence


def fill(template: Column | str, first_only: bool = False, **values: Column) -> Column:
    """Replace <<NAME>> and {{name}} placeholders; with first_only each only once."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        for mark in (f"<<<{name.upper()}>>>", f"<<{name.upper()}>>", "{{" + name.lower() + "}}"):
            if first_only:
                at = F.instr(out, mark)
                out = F.when(at > 0, F.concat(F.substring(out, F.lit(1), at - 1), value, F.substring(out, at + len(mark), F.length(out)))).otherwise(out)
            else:
                out = F.replace(out, F.lit(mark), value)
    return out


def title_of(passage_id: Column) -> Column:
    """The second part of an id between underscores, or nothing."""
    return F.coalesce(F.try_element_at(F.split(passage_id, "_"), F.lit(2)), F.lit(""))


def base_document_id(chunk_id: Column) -> Column:
    """A chunk id without its trailing _number."""
    return F.regexp_replace(chunk_id, r"^(.+)_\d+$", "$1")


def evidence(title: Column, content: Column) -> Column:
    return F.when(title != "", F.concat(F.lit("Title="), title, F.lit("; Content="), content)).otherwise(F.concat(F.lit("Content="), content))


def evidence_list(passages: Column, start: str = "", end: str = "") -> Column:
    """All passages (passage_id, text), in order, each as a marked line."""
    line = lambda p: F.concat(F.lit(f"[EVIDENCE]{start}Title: "), p["passage_id"], F.lit("\tContent: "), p["text"], F.lit(f"{end}\n"))
    return F.array_join(F.transform(passages, line), "")


def numbered_chunks(chunks: Column) -> Column:
    return F.array_join(F.transform(chunks, lambda c, i: F.concat(F.lit("[Chunk "), (i + 1).cast("string"), F.lit("]\n"), c)), "\n\n")


# Responses


def after_first(text: Column, mark: str = "[ANSWER]") -> Column:
    """What follows the first mark; null without one."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text)))


def after_last(text: Column, mark: str = "[ANSWER]") -> Column:
    """What follows the last mark, trimmed; the whole text without one."""
    return F.trim(F.substring_index(text, mark, -1))


def clean_answer(text: Column) -> Column:
    bare = F.replace(text, F.lit("\n"), F.lit(""))
    return F.trim(F.replace(F.replace(bare, F.lit("\"' '\""), F.lit('"')), F.lit("', '"), F.lit('"')))


def judge_score(text: Column) -> Column:
    """The number after the last 'Score:', 0.0 if there is none."""
    return F.coalesce(F.trim(F.substring_index(text, "Score:", -1)).try_cast("double"), F.lit(0.0))


def last_integer(text: Column, invalid: int = -9999999) -> Column:
    """The last integer of an answer, commas between digits ignored."""
    found = F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(r"(\d+)"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)).try_cast("bigint"), F.lit(invalid).cast("bigint"))


#: Marks that a turn may start with.
BULLETS = ("[THINK]", "[RETRIEVE]", "[ANSWER]", "[EVIDENCE]")


def violates_format(responses: Column) -> Column:
    """Some response after the first turn starts with no mark, or has a mark between its first [RETRIEVE] and the next."""
    any_of = "|".join(b.replace("[", r"\[").replace("]", r"\]") for b in BULLETS)

    def bad(t: Column) -> Column:
        parts = F.split(t, r"\[RETRIEVE\]", -1)
        return ~F.regexp_like(t, F.lit(rf"^\n*(?:{any_of})")) | F.coalesce(F.regexp_like(F.get(parts, 1), F.lit(any_of)), F.lit(False))

    return F.exists(F.slice(responses, 2, F.greatest(F.size(responses), F.lit(1))), bad)


def agent_action(text: Column) -> Column:
    """kind (search, view, next_page, answer or none) and argument of an agent's response."""
    arg = lambda p: F.regexp_extract(text, p, 1)
    kinds = [("search", r"RETRIEVE_SEARCH\((.*?)\)"), ("view", r"RETRIEVE_VIEW\((\d+)\)"), ("next_page", r"(RETRIEVE_NEXTPAGE)"), ("answer", r"(?s)\[ANSWER\](.*)")]
    out = F.struct(F.lit("none").alias("kind"), F.lit("").alias("argument"))
    for kind, pattern in reversed(kinds):
        out = F.when(F.regexp_like(text, F.lit(pattern)), F.struct(F.lit(kind).alias("kind"), arg(pattern).alias("argument"))).otherwise(out)
    return out


# Quotes and citations

TEXT_QUOTE = r"(?s)\[(\d+)\]\s*(.*?)(?=\n\[\d+\]|\nImage Quotes are:|\z)"
IMAGE_QUOTE = r"(?s)image(\d+)\s+is described as:\s*(.*?)(?=\nimage\d+\s+is described as:|\nThe user question is:|\z)"


def text_quotes(prompt: Column) -> Column:
    """quote_id and text of the numbered quotes in a prompt."""
    pairs = F.arrays_zip(F.regexp_extract_all(prompt, F.lit(TEXT_QUOTE), F.lit(1)).alias("i"), F.regexp_extract_all(prompt, F.lit(TEXT_QUOTE), F.lit(2)).alias("t"))
    return F.transform(pairs, lambda p: F.struct(F.concat(F.lit("text"), p["i"]).alias("quote_id"), normalize_space(p["t"]).alias("text")))


def image_quotes(prompt: Column) -> Column:
    pairs = F.arrays_zip(F.regexp_extract_all(prompt, F.lit(IMAGE_QUOTE), F.lit(1)).alias("i"), F.regexp_extract_all(prompt, F.lit(IMAGE_QUOTE), F.lit(2)).alias("t"))
    return F.transform(pairs, lambda p: F.struct(F.concat(F.lit("image"), p["i"]).alias("quote_id"), normalize_space(p["t"]).alias("text")))


def question_of(prompt: Column) -> Column:
    return normalize_space(F.regexp_extract(prompt, r"(?s)The user question is:\s*(.*)", 1))


def citations(answer: Column) -> Column:
    """Ids cited as [n] or ![..](imagen), sorted, each once."""
    texts = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda i: F.concat(F.lit("text"), i))
    images = F.transform(F.regexp_extract_all(answer, F.lit(r"!\[[^\]]*\]\(image(\d+)\)"), F.lit(1)), lambda i: F.concat(F.lit("image"), i))
    return F.array_sort(F.array_distinct(F.concat(texts, images)))


# Pages, paths, experiments


def page_numbers(pages: Column) -> Column:
    """page_5 and 5 as numbers, blanks dropped, first places kept."""
    read = F.transform(pages, lambda p: F.regexp_replace(F.trim(p.cast("string")), r"^page_", "").try_cast("int"))
    return F.array_distinct(F.filter(read, lambda p: p.isNotNull()))


def slide_paths(path: Column, pages: Column) -> Column:
    """A slide image's path with its page number replaced by each of pages."""
    return F.transform(pages, lambda p: F.regexp_replace(path, F.lit(r"_page_\d+(\.\w+)$"), F.concat(F.lit("_page_"), p.cast("string"), F.lit("$1"))))


def run_parameters(name: Column) -> Column:
    """K, TakeN, TopK and TopP out of a run directory's name; TopP is 1.0 by default."""
    number = lambda k, kind: F.nullif(F.regexp_extract(name, rf"(?:^|[-_/]){k}=([0-9.]+?)(?=[-_/]|$)", 1), F.lit("")).try_cast(kind)
    return F.struct(number("K", "int").alias("k"), number("TakeN", "int").alias("take_n"), number("TopK", "int").alias("top_k"), F.coalesce(number("TopP", "double"), F.lit(1.0)).alias("top_p"))


def parse_list(text: Column) -> Column:
    """A list of strings from JSON, doubly encoded JSON or a Python literal's text; any other text is a list of itself."""
    t = F.trim(text)
    as_json = F.from_json(t, "array<string>")
    twice = F.from_json(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>")[0], "array<string>")
    pythonic = F.from_json(F.regexp_replace(t, r"(?<=[\[,]\s{0,8})'((?:[^'\\]|\\.)*)'(?=\s*[\],])", '"$1"'), "array<string>")
    looks = t.startswith("[")
    return F.when(t.isNull() | (t == ""), F.array().cast("array<string>")).otherwise(F.coalesce(F.when(looks, as_json), F.when(looks, pythonic), F.when(t.startswith('"['), twice), F.array(t)))


def content_valid(text: Column, least: int | None = None, most: int | None = None) -> Column:
    """Length within bounds, and some character beyond ASCII."""
    ok = F.regexp_like(text, F.lit(r"[^\x00-\x7F]"))
    if least is not None:
        ok = ok & (F.length(text) >= least)
    if most is not None:
        ok = ok & (F.length(text) <= most)
    return F.coalesce(ok, F.lit(False))


def stable_number(text: Column) -> Column:
    """The first 16 hex digits of the SHA-256 as a whole number below 2^64."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def joined_text(parts: Column, sep: str = " ") -> Column:
    """A list of texts as one, blanks left out."""
    return F.array_join(F.filter(parts, lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), sep)


def route(key: Column, n: int) -> Column:
    """The engine, of n, that a key goes to: its CRC-32 modulo n."""
    return F.pmod(F.crc32(key.cast("binary")), F.lit(n)).cast("int")


def shared_words(a: Column, b: Column) -> Column:
    """How many different words two texts have in common."""
    return F.size(F.array_intersect(F.array_distinct(words(a)), F.array_distinct(words(b))))


def truncate_tokens(text: Column, n: int) -> Column:
    """A text up to the end of its n-th token (a run without white space), as it is; whole if it has fewer."""
    return F.array_join(F.slice(F.split(text, r"(?<=\S)(?=\s)", n + 1), 1, n), "") if n else F.lit("")


def context_and_question(messages: Column) -> Column:
    """context and question of a prompt: the first user turn with content, and the user turn after it; '' if there is none."""
    user = F.filter(messages, lambda m: m["role"] == "user")

    def parts(u: Column) -> Column:
        at = F.array_min(F.filter(F.transform(u, lambda m, i: F.when(F.coalesce(m["content"], F.lit("")) != "", i)), lambda i: i.isNotNull()))
        text = lambda i: F.coalesce(F.get(u, i)["content"], F.lit(""))
        return F.struct(F.coalesce(text(at), F.lit("")).alias("context"), F.coalesce(text(at + 1), F.lit("")).alias("question"))

    return F.when(F.size(messages) >= 3, let(user, parts)).otherwise(F.struct(F.lit("").alias("context"), F.lit("").alias("question")))


def exact_match(answer: Column, gold: Column) -> Column:
    """The reward of an answer that is the gold one as it stands: 1 or 0."""
    return F.coalesce((answer == gold).cast("int"), F.lit(0))


def key_candidates(key: str) -> list[str]:
    """Spellings of a parameter's name: as it is, with _ and with -; of a nested name only the first part varies, its own parts too."""
    if "." in key:
        head, rest = key.split(".", 1)
        return [f"{h}.{rest}" for h in key_candidates(head)]
    return [key, key.replace("-", "_"), key.replace("_", "-")]


def parameter(parameters: Column, key: str) -> Column:
    """The value of the first spelling of a name that a map of parameters has."""
    return F.coalesce(*[F.try_element_at(parameters, F.lit(k)) for k in dict.fromkeys(key_candidates(key))])


def one_image_mark(text: Column) -> Column:
    """Neighbouring <image> marks as one."""
    return F.regexp_replace(text, "(<image>)+", "<image>")


def example_length(turns: Column, passages: Column, images: Column, image_tokens: Column | None = None) -> Column:
    """Tokens (runs without white space) of the longest prompt that a passage makes, and the largest image's own.

    turns: texts, the last one the response, the one before it with <<<EVIDENCE>>>; passages: structs of text and images (paths), null or
    empty for none; images: of the example itself; image_tokens: a map from path to tokens.
    """

    def of(p: Column) -> Column:
        own = F.coalesce(p["images"], F.array().cast("array<string>"))
        marks = F.when(F.size(own) > 0, F.concat(F.array_join(F.transform(own, lambda _: F.lit("<image>")), " "), F.lit(" "))).otherwise("")
        evidence = F.when(F.size(own) > 0, F.trim(F.concat(marks, F.coalesce(p["text"], F.lit(""))))).otherwise(F.coalesce(p["text"], F.lit("")))
        filled = F.transform(turns, lambda t, i: F.when(i == F.size(turns) - 2, F.replace(t, F.lit("<<<EVIDENCE>>>"), evidence)).otherwise(t))
        whole, every = F.array_join(filled, ""), F.concat(images, own)
        marked = F.when((F.size(every) > 0) & ~F.contains(whole, F.lit("<image>")), F.concat(F.lit("<image> "), whole)).otherwise(whole)
        largest = F.lit(0)
        if image_tokens is not None:
            largest = F.coalesce(F.array_max(F.transform(every, lambda x: F.coalesce(F.try_element_at(image_tokens, x), F.lit(0)))), F.lit(0))
        return count_words(one_image_mark(marked)) + largest

    none = F.array(F.struct(F.lit("").alias("text"), F.array().cast("array<string>").alias("images")))
    return F.array_max(F.transform(F.when(F.size(passages) > 0, passages).otherwise(none), of))


REWRITES = {
    "rewrite": lambda q, r, ids, docs: F.regexp_extract_all(r, F.lit(r"- Rewrite \d+: (.+)"), F.lit(1)),
    "rewrite_with_reasoning": lambda q, r, ids, docs: F.regexp_extract_all(r, F.lit(r"- Rewrite \d+: (.+)"), F.lit(1)),
    "expand_with_answer": lambda q, r, ids, docs: F.transform(F.regexp_extract_all(r, F.lit(r"- Answer \d+: (.+)"), F.lit(1)), lambda a: F.concat(q, F.lit(" "), a)),
    "question_and_gold_document": lambda q, r, ids, docs: F.transform(docs, lambda d: F.concat(q, F.lit(" "), F.substring(d, 1, 4096))),
    "gold_document": lambda q, r, ids, docs: F.transform(docs, lambda d: F.substring(d, 1, 4096)),
    "question_and_gold_entity": lambda q, r, ids, docs: F.transform(ids, lambda i: F.concat(q, title_of(i))),
    "gold_entity": lambda q, r, ids, docs: F.transform(ids, title_of),
    "question_and_generated": lambda q, r, ids, docs: F.array(F.concat(q, r)),
    "generated": lambda q, r, ids, docs: F.array(r),
    "question_and_generated_plain": lambda q, r, ids, docs: F.array(_generated(q, r, True)),
    "question_and_generated_entity": lambda q, r, ids, docs: F.array(_generated(q, r, False)),
}


def _generated(q: Column, r: Column, with_content: bool) -> Column:
    title, content = F.regexp_extract(r, r"- TITLE: (.+)", 1), F.regexp_extract(r, r"- CONTENT: (.+)", 1)
    full = F.concat_ws(" ", q, title, content) if with_content else F.concat_ws(" ", q, title)
    return F.when((title == "") | (content == ""), F.concat(q, r)).otherwise(full)


def rewritten_queries(method: str, question: Column, response: Column, gold_ids: Column, gold_texts: Column) -> Column:
    """The queries that a rewriting method makes. expand_with_answer joins the question to each answer, as its name says."""
    return REWRITES[method](question, response, gold_ids, gold_texts)
