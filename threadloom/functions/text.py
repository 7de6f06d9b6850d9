"""Scalar text functions as Column expressions; all of them stay in the JVM, but for ``settled_number``."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Words that carry no content.
STOPWORDS = "a an and are as at be by for from has he in is it its of on that the to was were will with who what when where which how".split()
ARTICLES = ("a", "an", "the")
#: ASCII punctuation.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
#: White space that is more or other than one space.
SPACE = r"\s{2,}|[\t\n\x0B\f\r]"
#: A whole token of three or more characters that is no stop word.
CONTENT = rf"(?<![A-Za-z0-9])(?!(?i:{'|'.join(w for w in STOPWORDS if len(w) > 2)})(?![A-Za-z0-9]))[A-Za-z0-9]{{3,}}"


def lower_found(text: Column, pattern: str) -> Column:
    """ASCII matches without white space, lower-cased after matching, all at once: a lambda a token costs more than the rest."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    return F.array_remove(F.split(F.lower(F.array_join(found, " ")), " "), "")


def tokenize(text: Column) -> Column:
    """ASCII alphanumeric runs, lower-cased after matching."""
    return lower_found(text, "[A-Za-z0-9]+")


def content_tokens(text: Column) -> Column:
    """Tokens of three or more characters outside the stop list; order and repeats stay."""
    return lower_found(text, CONTENT)


def entity_tokens(text: Column) -> Column:
    """Content tokens, or else the first four tokens of two or more characters."""
    # bound by a lambda, so they are not found again for the answer
    chosen = F.transform(F.array(content_tokens(text)), lambda c: F.when(F.size(c) > 0, c).otherwise(F.slice(lower_found(text, "[A-Za-z0-9]{2,}"), 1, 4)))
    return F.get(chosen, F.lit(0))


def squash(text: Column) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def strip_space(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))


def sentences(text: Column) -> Column:
    """Split after ., ! or ? at white space; trimmed, without empty ones."""
    # what is left of a trimmed text starts and ends with no white space, and is empty only if the text is
    return F.array_remove(F.split(strip_space(text), r"(?<=[.!?])\s+"), "")


def _window(group: Column, size: int, stride: int, least: int, most_chars: int, first: bool) -> Column:
    """Joined sentence windows of one group; a short tail is dropped where a chunk precedes it."""
    n = F.size(group)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(stride)))
    reached = lambda s: (s == 0) | (s - stride + size < n)  # noqa: E731  the window before did not reach the end
    enough = lambda s: (F.least(n, s + size) - s >= least) | ((s == 0) & F.lit(first))
    kept = F.filter(starts, lambda s: reached(s) & (enough(s) | (n <= size)))
    clip = (lambda c: F.substring(c, 1, most_chars)) if most_chars > 0 else (lambda c: c)
    return F.transform(kept, lambda s: strip_space(clip(F.array_join(F.slice(group, s + 1, F.lit(size)), " "))))


def passage_chunks(text: Column, size: int = 3, stride: int = 2, least: int = 2, most_chars: int = 900, by_paragraph: bool = False) -> Column:
    """Sliding windows of sentences, clipped, white space squashed, without repeats."""
    clean = F.coalesce(text, F.lit(""))
    if by_paragraph:
        groups = F.transform(F.split(strip_space(clean), r"\n\s*\n+"), sentences)
        chunks = F.flatten(F.transform(groups, lambda g, i: _window(g, size, stride, least, most_chars, False)))
    else:
        # bound by a lambda, so the sentences are not split again for every window
        chunks = F.flatten(F.transform(F.array(sentences(clean)), lambda g: _window(g, size, stride, least, most_chars, True)))
    made = F.array_remove(F.array_distinct(F.transform(chunks, squash)), "")
    whole = strip_space(clean)
    fallback = F.when(whole == "", F.array().cast("array<string>")).otherwise(F.array(F.substring(whole, 1, most_chars) if most_chars > 0 else whole))
    return F.get(F.transform(F.array(made), lambda m: F.when(F.size(m) > 0, m).otherwise(fallback)), F.lit(0))


def match_key(text: Column) -> Column:
    return F.lower(squash(text))


def answer_tokens(text: Column) -> Column:
    """Lower case, without punctuation and articles."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    return F.filter(F.split(squash(bare), " "), lambda t: ~t.isin("", *ARTICLES))


def answer_key(text: Column) -> Column:
    return F.array_join(answer_tokens(text), " ")


def lexical_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def query_key(text: Column, most_chars: int = 384) -> Column:
    return F.substring(squash(text), 1, most_chars)


def clip(text: Column, most_chars: int) -> Column:
    return F.substring(strip_space(text), 1, most_chars) if most_chars > 0 else strip_space(text)


def jaccard(a: Column, b: Column) -> Column:
    """0 where either set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded half away from zero by the double itself, as the SQL's ``round`` does it; Spark's own rounds the shortest decimal that prints as the double, which differs on ties."""
    return F.round(value * 10.0**digits) / 10.0**digits


def settled(value: Column, digits: int = 6) -> Column:
    """Rounded a hair above, off the ties of short decimals, so that all engines round them alike."""
    return rounded(value + 10.0 ** -(digits + 3), digits)


def settled_number(value: float, digits: int = 6) -> float:
    """``settled`` of a plain number, for work inside a task; Python's own ``round`` sends ties of the double to even digits."""
    scaled = (value + 10.0 ** -(digits + 3)) * 10.0**digits
    whole = math.floor(abs(scaled))
    return math.copysign(whole + (abs(scaled) - whole >= 0.5), scaled) / 10.0**digits


def ratio(numerator: Column, denominator: Column) -> Column:
    """0 where the denominator is not positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(0.0)


def min_max_map(value: Column, *group: str) -> Column:
    """Scores of a map to 0..1; one value alone is 1 if positive."""
    w = Window.partitionBy(*group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.when(high > 0, 1.0).otherwise(0.0))


def min_max_list(value: Column, *group: str) -> Column:
    """Scores of a list to 0..1; without a span all are 0."""
    w = Window.partitionBy(*group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (value - low) / (high - low)).otherwise(0.0)


def min_max_vector(value: Column, *group: str) -> Column:
    """As of a map, with spans up to 1e-12 taken for none."""
    w = Window.partitionBy(*group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high - low > 1e-12, (value - low) / (high - low)).otherwise(F.when(high > 0, 1.0).otherwise(0.0))


def sentence_unit(title: Column, index: Column) -> Column:
    return F.concat_ws("::", title, index)


def chunk_unit(title: Column, index: Column) -> Column:
    return F.concat_ws("::", F.lit("chunk"), title, index)


def parse_unit(unit: Column) -> Column:
    """Struct (kind, title, index) of a unit id, read from the right; titles may hold ``::``."""
    chunk = F.regexp_extract(unit, r"^chunk::(.*)::(\d+)$", 2) != ""
    sentence = F.regexp_extract(unit, r"^(.*)::(\d+)$", 2) != ""
    kind = F.when(chunk, "chunk").when(sentence, "sentence").otherwise("unknown")
    title = F.when(chunk, F.regexp_extract(unit, r"^chunk::(.*)::(\d+)$", 1)).when(sentence, F.regexp_extract(unit, r"^(.*)::(\d+)$", 1)).otherwise("")
    index = F.when(sentence, F.regexp_extract(unit, r"::(\d+)$", 1).try_cast("int"))
    return F.struct(kind.alias("kind"), title.alias("title"), index.alias("index"))


def role_of(overlap: Column, connector: Column, support: Column) -> Column:
    return F.when(overlap >= 1, "query").when(connector | support, "bridge").otherwise("answer")


def post_process(raw: Column, question: Column) -> Column:
    """A model's text to an answer: no think block, text after the last ``Answer:``, first line, yes or no folded."""
    text = strip_space(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?is)<think>.*?</think>", ""))
    text = strip_space(F.element_at(F.split(text, r"(?i)answer\s*:"), -1))
    line = F.coalesce(F.get(F.filter(F.transform(F.split(text, r"\n"), strip_space), lambda x: x != ""), F.lit(0)), F.lit(""))
    closed = F.lower(strip_space(question)).rlike(r"^(is|are|was|were|do|does|did|can|could|has|have|had|will|would|should)\b")
    word = F.lower(F.regexp_extract(line, r"^(?i)(yes|no)\b", 1))
    return F.when(closed & (word != ""), word).otherwise(line)


def parse_triples(raw: Column) -> Column:
    """(subject, predicate, object) triples of a JSON answer; lists and keyed objects are read, repeats dropped."""
    body = F.regexp_extract(F.regexp_replace(F.coalesce(raw, F.lit("")), "```(?:json)?", ""), r"(?s)([\[{].*[\]}])", 1)
    keyed = F.from_json(body, "triples array<string>, relations array<string>, facts array<string>")
    items = F.coalesce(keyed["triples"], keyed["relations"], keyed["facts"], F.from_json(body, "array<string>"), F.array().cast("array<string>"))

    def triple(item: Column) -> Column:
        listed = F.from_json(item, "array<string>")
        named = F.from_json(item, "subject string, head string, predicate string, relation string, object string, tail string")
        parts = F.split(item, r"\s*\|\s*")
        return F.struct(
            strip_space(F.coalesce(F.get(listed, F.lit(0)), named["subject"], named["head"], F.when(F.size(parts) == 3, parts[0]))).alias("subject"),
            strip_space(F.coalesce(F.get(listed, F.lit(1)), named["predicate"], named["relation"], F.when(F.size(parts) == 3, parts[1]))).alias("predicate"),
            strip_space(F.coalesce(F.get(listed, F.lit(2)), named["object"], named["tail"], F.when(F.size(parts) == 3, parts[2]))).alias("object"),
        )

    made = F.transform(items, triple)
    return F.array_distinct(F.filter(made, lambda t: (t["subject"] != "") & (t["predicate"] != "") & (t["object"] != "")))
