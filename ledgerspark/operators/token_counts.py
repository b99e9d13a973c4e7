"""Token counts of texts by the tokenizer of their model, as a table that is kept.

A count's key is the digest of the tokenizer's specification and that of the text, so equal texts are encoded
once, whatever record they are of, and a later import finds them counted.  New keys are found by an
anti join, one text of each is encoded by tasks, and what they count is appended to the table.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from importlib.metadata import version
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import exists, materialize

TABLE = "spec string, text_sha256 string, tokens bigint"
#: What a counted size says of its tokenizer beside the number.
METADATA = ("encoding", "package_version", "mapping", "mapping_sha256")

_encodings: dict[str, object] = {}


def _encoding(spec: dict):
    """The encoding of a specification, loaded once in each process; its file must still be what it was."""
    name = digest(spec)
    if name not in _encodings:
        import tiktoken

        content = Path(spec["bpe_path"]).read_bytes()
        if hashlib.sha256(content).hexdigest() != spec["sha256"]:
            raise ValueError("the tokenizer's file changed")
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, content.splitlines()))}
        _encodings[name] = tiktoken.Encoding(name=spec["encoding"], pat_str=spec["pattern"], mergeable_ranks=ranks, special_tokens=spec.get("special_tokens", {}))
    return _encodings[name]


def digest(spec: dict) -> str:
    return hashlib.sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest()


class TokenCounter:
    """Counts for models that have a verified tokenizer.

    ``path`` is the folder of the kept table, on storage that driver and executors share; without one, counts
    live as long as the application.  Tokenizer files are read by the tasks, so they must be where
    tasks run.
    """

    def __init__(self, specs: dict[str, dict], path: str | None = None):
        self.specs, self.path, self.encoded = specs, path, 0
        self._digests = {model: digest(s) for model, s in specs.items()}

    def _of(self, model: Column, values: dict[str, str]) -> Column:
        pairs = [F.lit(x) for pair in values.items() for x in pair]
        return F.element_at(F.create_map(*pairs), model) if pairs else F.lit(None).cast("string")

    def spec(self, model: Column) -> Column:
        """The digest of the model's tokenizer; NULL where it has none."""
        return self._of(model, self._digests)

    def metadata(self, model: Column) -> dict[str, Column]:
        told = {m: {"encoding": s["encoding"], "package_version": version("tiktoken"), "mapping": "explicit_local_model_map", "mapping_sha256": s["sha256"]} for m, s in self.specs.items()}
        return {k: self._of(model, {m: v[k] for m, v in told.items()}) for k in METADATA}

    def kept(self, spark) -> DataFrame:
        """All counts so far; one row a key, also where an interrupted import wrote a key twice."""
        rows = spark.read.schema(TABLE).parquet(self.path) if self.path and exists(spark, self.path) else spark.createDataFrame([], TABLE)
        return rows.groupBy("spec", "text_sha256").agg(F.min("tokens").alias("tokens"))

    def count(self, texts: DataFrame) -> DataFrame:
        """``spec, text_sha256, tokens`` of all ``(spec, text_sha256, text)`` rows; new keys are encoded and kept."""
        spark = texts.sparkSession
        wanted = texts.where("spec is not null and text is not null")
        known = self.kept(spark)
        new = wanted.join(known, ["spec", "text_sha256"], "left_anti").groupBy("spec", "text_sha256").agg(F.first("text").alias("text"))
        by_digest = {self._digests[m]: s for m, s in self.specs.items()}

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                # one call for a tokenizer's texts of a batch, on as many threads as a task has
                specs, texts = b.column(0).to_pylist(), b.column(2).to_pylist()
                found = [0] * len(texts)
                for s in set(specs):
                    at = [k for k, x in enumerate(specs) if x == s]
                    for k, ids in zip(at, _encoding(by_digest[s]).encode_batch([texts[k] for k in at], num_threads=1, disallowed_special=()), strict=True):
                        found[k] = len(ids)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.int64())], ["spec", "text_sha256", "tokens"])

        made = materialize(new.select("spec", "text_sha256", "text").mapInArrow(task, TABLE), "counts")
        self.encoded += made.count()
        if self.path:
            made.write.mode("append").parquet(self.path)
        return known.join(wanted.select("spec", "text_sha256").distinct(), ["spec", "text_sha256"], "left_semi").unionByName(made) if not self.path else self.kept(spark)

    def with_tokens(self, rows: DataFrame, texts: dict[str, Column], model: str = "model") -> DataFrame:
        """``rows`` with a column of tokens for each of ``texts`` (a new column's name to a text)."""
        keys = {n: F.struct(self.spec(F.col(model)).alias("spec"), F.sha2(t, 256).alias("text_sha256")) for n, t in texts.items()}
        # texts and their keys are expressions of the rows' columns: rows should be a table
        each = [rows.select(keys[n].alias("k"), t.alias("text")).select("k.spec", "k.text_sha256", "text") for n, t in texts.items()]
        every = each[0]
        for more in each[1:]:
            every = every.unionByName(more)
        found = materialize(self.count(every), "counted")
        for n in texts:
            own = found.select(F.col("spec").alias("_spec"), F.col("text_sha256").alias("_sha"), F.col("tokens").alias(n))
            rows = rows.withColumn("_k", keys[n]).join(own, (F.col("_k.spec") == F.col("_spec")) & (F.col("_k.text_sha256") == F.col("_sha")), "left").drop("_k", "_spec", "_sha")
        return rows
