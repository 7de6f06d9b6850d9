"""Question datasets, corpora and results: readers of their layouts, and sinks."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

SPLITS = ("validation", "dev", "test", "train")
TEXT_KEYS = ("sentences", "text", "paragraph_text", "passage", "content", "context")
SAMPLE = "qid string, question string, answer string, contexts array<struct<title: string, sentences: array<string>>>, supporting_facts array<struct<title: string, sent_idx: int>>, metadata map<string, string>"


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """One JSON record per row as text, in ``pos`` order; a JSON file's ``data`` or ``examples`` list is unwrapped."""
    if path.endswith(".jsonl"):
        lines = spark.read.text(path).filter(F.trim("value") != "")
        return lines.select(F.monotonically_increasing_id().alias("pos"), F.col("value").alias("record"))
    whole = spark.read.text(path, wholetext=True)
    items = F.coalesce(F.from_json("value", "array<string>"), F.from_json("value", "data array<string>")["data"], F.from_json("value", "examples array<string>")["examples"])
    return whole.select(F.posexplode(items).alias("pos", "record"))


def find_local(dataset: str, roots: tuple[str, ...] = ("data/qa", "data")) -> str | None:
    return next((p for r in roots for p in (os.path.join(r, f"{dataset}.json"),) if os.path.exists(p)), None)


def _json(path: str) -> Column:
    return F.get_json_object("record", path)


def _first(*paths: str) -> Column:
    return F.coalesce(*(F.nullif(T.strip_space(_json(p)), F.lit("")) for p in paths), F.lit(""))


def sentence_list(value: Column) -> Column:
    """A list of sentences, or a text to split."""
    listed = F.filter(F.transform(F.from_json(value, "array<string>"), T.strip_space), lambda s: s != "")
    return F.coalesce(listed, F.when(value.isNotNull(), T.sentences(value)), F.array().cast("array<string>"))


def contexts(path: str) -> Column:
    """Documents of a context in any layout: parallel arrays, [title, sentences] pairs, or keyed objects."""
    raw = _json(path)
    pairs = F.from_json(raw, "array<array<string>>")
    columns = F.from_json(raw, "title array<string>, sentences array<string>")
    objects = F.from_json(raw, "array<string>")
    doc = lambda title, sents: F.struct(T.strip_space(title).alias("title"), sents.alias("sentences"))
    by_pair = F.transform(pairs, lambda p: doc(F.get(p, F.lit(0)), sentence_list(F.get(p, F.lit(1)))))
    by_column = F.transform(columns["title"], lambda t, i: doc(t, sentence_list(F.get(columns["sentences"], i))))
    key = lambda o, *names: F.coalesce(*(F.get_json_object(o, f"$.{n}") for n in names))
    by_object = F.transform(objects, lambda o: doc(F.coalesce(key(o, "title", "document_title", "name"), F.lit("")), sentence_list(key(o, *TEXT_KEYS))))
    found = F.coalesce(F.when(F.size(F.coalesce(columns["title"], F.array())) > 0, by_column), F.when(F.exists(pairs, lambda p: p.isNotNull()), by_pair), by_object)
    return F.coalesce(F.filter(found, lambda d: F.size(d["sentences"]) > 0), F.array().cast("array<struct<title: string, sentences: array<string>>>"))


def facts(path: str) -> Column:
    """Supporting facts in any layout, without repeats, in order; bad indexes are 0."""
    raw = _json(path)
    columns = F.from_json(raw, "title array<string>, sent_id array<string>")
    pairs = F.from_json(raw, "array<array<string>>")
    objects = F.from_json(raw, "array<struct<title: string, sent_id: string, sent_idx: string>>")
    fact = lambda t, i: F.struct(T.strip_space(t).alias("title"), F.coalesce(i.try_cast("int"), F.lit(0)).alias("sent_idx"))
    by_column = F.transform(columns["title"], lambda t, i: fact(t, F.get(columns["sent_id"], i)))
    by_pair = F.transform(pairs, lambda p: fact(F.get(p, F.lit(0)), F.get(p, F.lit(1))))
    by_object = F.transform(objects, lambda o: fact(o["title"], F.coalesce(o["sent_id"], o["sent_idx"])))
    found = F.coalesce(F.when(F.size(F.coalesce(columns["title"], F.array())) > 0, by_column), F.when(F.exists(pairs, lambda p: p.isNotNull()), by_pair), by_object)
    return F.coalesce(F.array_distinct(F.filter(found, lambda f: f["title"] != "")), F.array().cast("array<struct<title: string, sent_idx: int>>"))


def flagged_facts(path: str, docs: Column) -> Column:
    """Facts from paragraph flags: every sentence of each supporting paragraph, at least its first."""
    flags = F.from_json(_json(path), "array<struct<title: string, is_supporting: boolean>>")
    titles = F.transform(F.filter(flags, lambda p: p["is_supporting"]), lambda p: T.strip_space(p["title"]))

    def of(title: Column) -> Column:
        doc = F.get(F.filter(docs, lambda d: d["title"] == title), F.lit(0))
        last = F.greatest(F.coalesce(F.size(doc["sentences"]), F.lit(1)), F.lit(1)) - 1
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(title.alias("title"), i.alias("sent_idx")))

    return F.array_distinct(F.flatten(F.transform(F.coalesce(titles, F.array().cast("array<string>")), of)))


def answer() -> Column:
    aliases = F.from_json(_json("$.possible_answers"), "array<string>")
    return F.coalesce(F.nullif(_first("$.answer"), F.lit("")), F.nullif(_first("$.obj"), F.lit("")), F.get(aliases, F.lit(0)), F.lit(""))


def parse(records: DataFrame, dataset: str, source: str = "path") -> DataFrame:
    """Samples of a dataset; blank ids become ``{dataset}-{pos}``."""
    given = contexts("$.context")
    docs = F.when(F.size(given) > 0, given).otherwise(contexts("$.paragraphs"))
    if dataset == "popqa":
        spoken = F.concat_ws(" ", _first("$.subj"), _first("$.prop"), _first("$.obj"))
        one = F.array(F.struct(_first("$.subj").alias("title"), F.array(spoken).alias("sentences")))
        docs = F.when(F.size(docs) > 0, docs).otherwise(one)
    listed = facts("$.supporting_facts")
    gold = F.when(F.size(listed) > 0, listed).otherwise(flagged_facts("$.paragraphs", docs))
    qid = _first("$._id", "$.id", "$.qid")
    meta = F.map_filter(F.create_map(F.lit("source"), F.lit(source), F.lit("type"), _json("$.type"), F.lit("answer_id"), _json("$.answer_id"), F.lit("possible_answers"), _json("$.possible_answers")), lambda k, v: v.isNotNull())
    return records.select("pos", F.when(qid == "", F.concat(F.lit(f"{dataset}-"), F.col("pos").cast("string"))).otherwise(qid).alias("qid"), _first("$.question", "$.query").alias("question"), answer().alias("answer"), docs.alias("contexts"), gold.alias("supporting_facts"), meta.alias("metadata"))


#: One built-in sample per dataset, used when no file is found.
DEMO = {
    "hotpotqa": {"_id": "demo-h", "question": "Who wrote the play set at Elsinore?", "answer": "William Shakespeare", "context": [["Hamlet", ["Hamlet is a play by William Shakespeare.", "It is set at Elsinore."]], ["Elsinore", ["Elsinore is a town in Denmark."]]], "supporting_facts": [["Hamlet", 0], ["Hamlet", 1]]},
    "musique": {"id": "demo-m", "question": "Where does the river of Lyon end?", "answer": "Mediterranean Sea", "paragraphs": [{"title": "Lyon", "paragraph_text": "Lyon lies on the Rhone.", "is_supporting": True}, {"title": "Rhone", "paragraph_text": "The Rhone flows to the Mediterranean Sea.", "is_supporting": True}]},
    "2wikimultihopqa": {"_id": "demo-w", "question": "Is Mont Blanc higher than Ben Nevis?", "answer": "yes", "context": [["Mont Blanc", ["Mont Blanc is 4806 m high."]], ["Ben Nevis", ["Ben Nevis is 1345 m high."]]], "supporting_facts": [["Mont Blanc", 0], ["Ben Nevis", 0]]},
    "popqa": {"id": 1, "question": "What is the occupation of Marie Curie?", "subj": "Marie Curie", "prop": "occupation", "obj": "physicist", "possible_answers": "[\"physicist\", \"chemist\"]"},
}


def load_dataset(spark: SparkSession, dataset: str, path: str | None = None, limit: int | None = None, demo: bool = True) -> DataFrame:
    """Samples from a path, a local file, or the demo; the limit counts after parsing, in file order."""
    at = path or find_local(dataset)
    if at:
        samples = parse(raw_records(spark, at), dataset, "path" if path else "local")
    elif demo:
        samples = parse(spark.createDataFrame([(0, json.dumps(DEMO[dataset]))], "pos long, record string"), dataset, "demo")
    else:
        raise FileNotFoundError(f"no file for dataset {dataset!r}, and the demo is not allowed")
    return samples.orderBy("pos").limit(limit) if limit else samples


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Corpus rows (doc_id, title, text): lists are joined, blank texts dropped, bad ids become the position."""
    items = raw_records(spark, path)
    if not path.endswith(".jsonl"):
        docs = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "docs array<string>")["docs"]).alias("pos", "record"))
        items = items.union(docs)
    value = F.coalesce(*(_json(f"$.{k}") for k in ("text", "context", "passage")))
    joined = F.coalesce(F.array_join(F.from_json(value, "array<string>"), " "), value)
    rows = items.select(F.coalesce(_json("$.idx").try_cast("long"), F.col("pos").cast("long")).alias("doc_id"), _first("$.title", "$.name").alias("title"), T.strip_space(joined).alias("text"))
    return rows.filter("text != ''")


def read_retrieval(spark: SparkSession, path: str) -> DataFrame:
    """Stored retrieval results by question; of repeated ones the last line counts."""
    rows = raw_records(spark, path).select("pos", _first("$.sample_id", "$.qid").alias("qid"), "record").filter("qid != ''")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("pos")))
    return rows.withColumn("r", rank).filter("r = 1").select("qid", "record")


def import_graph(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A prebuilt graph: nodes by prefix of their names, parallel edges once with the largest weight."""
    kind = F.when(F.col("name").startswith("chunk-"), "chunk").when(F.col("name").startswith("entity-"), "entity")
    nodes = vertices.withColumn("kind", kind).filter("kind is not null")
    pairs = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").filter("src != dst")
    return nodes, pairs.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def write_samples(samples: DataFrame, path: str, overwrite: bool = False) -> None:
    """Normalized samples as JSON lines; an existing target is an error unless overwritten."""
    samples.select("qid", "question", "answer", "contexts", "supporting_facts", "metadata").write.mode("overwrite" if overwrite else "errorifexists").json(path)


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """A report of few rows as one CSV file with fixed columns."""
    rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns)).coalesce(1).write.mode("overwrite").csv(path, header=True)


def markdown(rows: DataFrame, columns: list[str]) -> str:
    """A report of few rows as a Markdown table."""
    body = [[str(r[c]) for c in columns] for r in rows.select(*columns).collect()]
    return "\n".join("| " + " | ".join(cells) + " |" for cells in [columns, ["---"] * len(columns), *body])


Loader = Callable[..., DataFrame]


class Registry:
    """Named plan builders; an unknown name lists those there are."""

    def __init__(self, kind: str):
        self.kind, self.entries = kind, {}

    def register(self, *names: str) -> Callable[[Callable], Callable]:
        def add(f: Callable) -> Callable:
            self.entries |= dict.fromkeys(names, f)
            return f

        return add

    def __getitem__(self, name: str) -> Callable:
        if name not in self.entries:
            raise KeyError(f"unknown {self.kind} {name!r}; known: {', '.join(sorted(self.entries))}")
        return self.entries[name]


DATASETS = Registry("dataset")
for _name, _dataset in (("hotpotqa", "hotpotqa"), ("musique", "musique"), ("2wiki", "2wikimultihopqa"), ("2wikimultihopqa", "2wikimultihopqa"), ("popqa", "popqa")):
    DATASETS.register(_name)(lambda spark, path=None, limit=None, demo=True, _d=_dataset: load_dataset(spark, _d, path, limit, demo))
