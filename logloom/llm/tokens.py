"""Token counts of byte-level BPE vocabularies: exact counts at every prefix of a text."""

from __future__ import annotations

import hashlib
import json
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

# Fixed value: how byte-level BPE vocabularies of this kind split texts before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Pieces whose counts a worker remembers.
REMEMBERED = 800_000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in such vocabularies: its own where it prints."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printing]
    return {b: chr(b) for b in printing} | {b: chr(256 + k) for k, b in enumerate(others)}


class PrefixCounter:
    """Token counts of the prefixes of texts, by a dynamic program over their pieces.

    The vocabulary merges inside pieces only, so the tokens of a text up to the
    end of a piece are those up to the end of the piece before, plus its own.
    Pieces recur, and each is encoded once. The string of an added token is a piece of one
    token, and ends the pieces on both sides of it.
    """

    def __init__(self, vocabulary: str):
        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        form = json.loads(vocabulary)
        front = form.get("pre_tokenizer") or {}
        added = form.get("added_tokens", [])
        self.by_pieces = (
            form["model"]["type"] == "BPE"
            and form.get("normalizer") is None
            and front.get("type") == "ByteLevel"
            and not front.get("add_prefix_space")
            and front.get("use_regex", True)
            and not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word"))
        )
        self.special = sorted((t["content"] for t in added), key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.split = regex.compile(SPLIT).findall
        self.letters = _byte_letters()
        self.known: dict[str, int] = {}

    @staticmethod
    def kept(vocabulary: str) -> PrefixCounter:
        """The counter of this worker, which later tasks of the same worker find again.

        It is kept with the interpreter, because what is sent to a worker comes anew with
        every task.
        """
        store = sys.modules.setdefault("logloom_kept", types.ModuleType("logloom_kept")).__dict__
        key = hashlib.sha256(vocabulary.encode()).hexdigest()
        if store.get("counter_of") != key:
            store["counter_of"], store["counter"] = key, PrefixCounter(vocabulary)
        return store["counter"]

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> int:
        """Tokens of one piece, by the model of the library alone."""
        return len(self.library.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))

    def pieces(self, text: str) -> list[str]:
        if not any(t in text for t in self.special):
            return self.split(text)
        # Odd parts are the strings of added tokens.
        parts = enumerate(self.cut(text))
        return [p for k, part in parts for p in ([part] if k % 2 else self.split(part))]

    def counted(self, text: str) -> tuple[list[str], list[int]] | None:
        """The pieces of a text and the tokens of each; None where pieces do not rule."""
        if not self.by_pieces:
            return None
        pieces, known = self.pieces(text), self.known
        counts = list(map(known.get, pieces))
        if None in counts:
            new = {p for p, n in zip(pieces, counts) if n is None}
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = set(pieces)
            special = set(self.special)
            known.update((p, 1 if p in special else self._piece(p)) for p in new)
            counts = list(map(known.__getitem__, pieces))
        return pieces, counts

    def table(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ends of the pieces in bytes, and the tokens up to each; None where pieces do not rule."""
        found = self.counted(text)
        if found is None:
            return None
        sizes = [len(p.encode()) for p in found[0]]
        return np.cumsum(sizes, dtype=np.int64), np.cumsum(found[1], dtype=np.int64)

    def fits(self, text: str, limit: int) -> tuple[int, int | None]:
        """Tokens of the text, and the bytes of its longest run of whole pieces within `limit`."""
        found = self.counted(text)
        if found is None:
            total = self.whole([text])[0]
            return total, len(text.encode()) if total <= limit else None
        pieces, counts = found
        tokens = np.cumsum(counts, dtype=np.int64)
        if not len(tokens) or tokens[-1] <= limit:
            return int(sum(counts)), len(text.encode())
        within = pieces[: int(np.searchsorted(tokens, limit, side="right"))]
        return int(tokens[-1]), sum(len(p.encode()) for p in within)


def prefix_tokens(counter: PrefixCounter, text: str, n_chars: int) -> int:
    """Tokens of the first `n_chars` characters, from the table of the whole text.

    Only the pieces that the cut may change are encoded: the one that it falls in
    and the one before, because white space looks ahead.
    """
    table = counter.table(text)
    head = text[:n_chars]
    if table is None:
        return counter.whole([head])[0]
    ends, tokens = table
    inside = int(np.searchsorted(ends, len(head.encode()), side="left")) - 1
    settled = inside - 1
    if settled < 0:
        return counter.whole([head])[0]
    tail = head.encode()[ends[settled] :].decode()
    return int(tokens[settled]) + counter.whole([tail])[0]


def count_tokens(
    docs: DataFrame,
    vocabulary_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
    with_table: bool = False,
) -> DataFrame:
    """Tokens of every whole text: the id, `n_bytes`, `n_tokens`, `over_limit`, `fit_bytes`.

    `n_tokens` is what the `tokenizers` library gives without added begin or end
    tokens, truncation or padding; strings of special tokens inside a text are
    treated as it treats them. `fit_bytes` are the bytes of the longest run of
    whole pieces, from the start, that stays within `limit`. `with_table` adds the
    prefix table: `ends`, the piece ends in bytes, and `tokens`, the count up to
    each; any later question about a budget or a cut is a search in it. Vocabularies
    that do not work by such pieces have no tables, and no `fit_bytes` for texts over
    the limit: these are null.

    Null texts count as empty, and empty ones have no tokens. Ids are passed
    through, null and repeated ones too. No shuffle. The vocabulary file is read
    on the driver and sent to the tasks.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = file.read()
    id_type = docs.schema[id_col].dataType.simpleString()
    extra = ", ends array<bigint>, tokens array<bigint>" if with_table else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter.kept(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            fits = [counter.fits(t, limit) for t in texts]
            columns = [
                batch.column(0),
                pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array([n for n, _ in fits], pa.int64()),
                pa.array([n > limit for n, _ in fits], pa.bool_()),
                pa.array([b for _, b in fits], pa.int64()),
            ]
            names = ["id", "n_bytes", "n_tokens", "over_limit", "fit_bytes"]
            if with_table:
                tables = [counter.table(t) for t in texts]
                for k, name in enumerate(("ends", "tokens")):
                    values = [None if t is None else t[k] for t in tables]
                    columns.append(pa.array(values, pa.list_(pa.int64())))
                    names.append(name)
            yield pa.RecordBatch.from_arrays(columns, names)

    counted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run,
        f"id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_bytes bigint"
        + extra,
    )
    return counted.withColumnRenamed("id", id_col)
