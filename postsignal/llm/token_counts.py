"""Token counts with a tokenizer file, returning lengths only.

Texts are cut at ASCII white space, which no token of the supported pipelines holds or looks across
(white space is removed before the merges, normal forms do not compose across it, and added tokens
contain none), so the count of a text is the sum of the counts of its parts and a text of any length
is many small inputs. The distinct parts of a batch that the worker does not remember go to the
library's batch encoder in groups of about ``GROUP_BYTES``; one long part is a group of its own. A
worker remembers a bounded number of parts.

A tokenizer for which the cuts are not known to be safe is given whole texts, in the same groups.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsignal.llm.common import by_bytes, text_slices, worker_state

#: Bytes of text worked on together, bytes per call of the encoder, parts that a worker keeps.
BATCH_BYTES, GROUP_BYTES, KEPT = 1 << 21, 1 << 18, 150_000
#: Split patterns that keep white space out of all tokens (fixed values).
SPACE_FREE = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)
#: Normalizers that act within a part.
LOCAL = ("NFC", "NFD", "NFKC", "NFKD", "Lowercase")


def cuts_at_spaces(config: dict) -> bool:
    """Whether the tokens of a text are those of its parts between ASCII white space."""
    split = config.get("pre_tokenizer") or {}
    steps = split.get("pretokenizers", [split])
    first = steps[0] if steps else {}
    removed = (
        first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and first.get("invert") is True
        and first.get("pattern", {}).get("Regex") in SPACE_FREE
    )
    later = all(s.get("type") == "ByteLevel" and not s.get("add_prefix_space") and not s.get("use_regex") for s in steps[1:])
    forms = config.get("normalizer") or {}
    forms = forms.get("normalizers", [forms] if forms else [])
    plain = all(
        f.get("type") in LOCAL or (f.get("type") == "Replace" and f.get("pattern") == {"Regex": "\\s+"} and f.get("content") == " ")
        for f in forms
    )
    added = not any(set(t["content"]) & set(" \t\n\r\x0b\x0c") for t in config.get("added_tokens", []))
    return removed and later and plain and added


class Counter:
    """Token counts of texts with one tokenizer, remembering parts."""

    def __init__(self, model: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_parts = cuts_at_spaces(json.loads(model))
        self.known, self.old = {}, {}

    def lengths(self, texts: list[bytes]) -> list[int]:
        """The encoder's counts, in groups of bounded size."""
        out = []
        for a, b in by_bytes(texts, GROUP_BYTES):
            coded = self.tokenizer.encode_batch_fast([x.decode() for x in texts[a:b]], add_special_tokens=False)
            out += map(len, coded)
        return out

    def counts(self, texts: list[bytes]) -> list[int]:
        if not self.by_parts:
            return self.lengths(texts)
        parts = [x.split() for x in texts]
        if len(self.known) > KEPT:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        new = set().union(*parts).difference(known)
        known.update((w, old[w]) for w in new if w in old)
        new = [w for w in new if w not in old]
        known.update(zip(new, self.lengths(new)))
        return [sum(map(known.__getitem__, p)) for p in parts]


def count_tokens(docs: DataFrame, path: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    Counts are those of the tokenizer file at ``path`` without begin, end or other added tokens; its
    special strings inside texts count as the library's default takes them, nothing is truncated.
    Null texts count as empty. Ids may be null or repeat, other columns are ignored, an empty table
    gives an empty result.
    """
    with open(path, encoding="utf-8") as file:
        model = file.read()

    def run(batches):
        from hashlib import sha256

        import pyarrow as pa

        counter = worker_state(("token counts", sha256(model.encode()).digest()), lambda: Counter(model))
        for batch in batches:
            sizes, found = [], []
            for _, _, texts in text_slices(batch.column(1), BATCH_BYTES):
                sizes += map(len, texts)
                found += counter.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
