"""Token counts of whole texts under public tokenizers, in Arrow batches that return lengths only."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftclust.llm.common import own_columns, utf8

#: Bytes of text handed to the tokenizer at once, whatever the number of pieces.
BATCH_BYTES = 1 << 20
#: Pieces whose lengths a worker remembers; beyond that it forgets them all and starts again.
REMEMBERED = 1 << 20
#: Longer pieces are encoded each time.
LONGEST_REMEMBERED = 256


def vocabulary_path(name: str) -> str:
    """A vocabulary by its path, or by its name among the public tokenizers of this machine."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def text_chunks(raw: bytes, limit: int = 4 * BATCH_BYTES) -> Iterator[bytes]:
    """A text in pieces of about ``limit`` bytes, cut at ASCII white space only."""
    at = 0
    while len(raw) - at > limit:
        cut = re.compile(rb"[\x20\x09-\x0D]").search(raw, at + limit)
        if not cut:
            break
        yield raw[at : cut.start()]
        at = cut.start()
    yield raw[at:]


def _split_words(raw: bytes) -> list[bytes]:
    """For tokenizers that drop white space: any ASCII white space is a safe boundary."""
    return raw.split()


_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def _split_spaced(raw: bytes) -> list[bytes]:
    """For tokenizers that give a space to the word after it: a single space between other characters opens a piece."""
    first, *rest = _SINGLE_SPACE.split(raw.decode("utf-8"))
    return [first.encode(), *((" " + x).encode() for x in rest)]


def _split_marked(raw: bytes) -> list[bytes]:
    """For tokenizers that write each word with a mark before it, which they also put before a text: the space itself goes."""
    return [x.encode() for x in _SINGLE_SPACE.split(raw.decode("utf-8"))] if raw else []


def _batches(pieces: list[bytes]) -> Iterator[list[str]]:
    part, size = [], 0
    for x in pieces:
        part.append(x.decode("utf-8"))
        size += len(x)
        if size >= BATCH_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


class TokenCounter:
    """Counts tokens of texts as the library of the vocabulary file gives them, without added special tokens.

    A text is split at its safe boundaries, where no token and no step of normalisation reaches across, so that the lengths of
    the pieces add up to the length of the text. Pieces are encoded in batches of about BATCH_BYTES, each distinct one once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_padding(), model.no_truncation()
            encode = getattr(model, "encode_batch_fast", model.encode_batch)
            self.encode: Callable = lambda texts: [len(x) for x in encode(texts, add_special_tokens=False)]
            probe = model.encode("a b", add_special_tokens=False).tokens
            self.split = _split_words if probe == [*model.encode("a", add_special_tokens=False).tokens, *model.encode("b", add_special_tokens=False).tokens] else _split_spaced
        elif path.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [len(model.encode_ordinary(x)) for x in texts]
            self.split = _split_spaced
        elif path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            inside = any("▁" in p[1:].lstrip("▁") for p in (model.id_to_piece(i) for i in range(model.get_piece_size())))
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.split = (lambda raw: [raw]) if inside else _split_marked
        else:
            raise ValueError(f"no library for {path}: .json, .tiktoken and .model are known")
        self.known: dict[bytes, int] = {}

    def count(self, raw: bytes) -> int:
        return self.counts([raw])[0]

    def counts(self, texts: list[bytes]) -> list[int]:
        known, rows, new = self.known, [], set()
        if len(known) > REMEMBERED:
            known.clear()
        once: dict[bytes, int] = {}
        for raw in texts:
            pieces = self.split(raw)
            rows.append(pieces)
            new.update(pieces)
        new = [x for x in new if x not in known]
        at = 0
        for part in _batches(new):
            for x, n in zip(new[at : at + len(part)], self.encode(part), strict=True):
                (known if len(x) <= LONGEST_REMEMBERED else once)[x] = n
            at += len(part)
        if not once:
            return [sum(map(known.__getitem__, pieces)) for pieces in rows]
        return [sum(known[x] if x in known else once[x] for x in pieces) for pieces in rows]


_COUNTERS: dict[str, TokenCounter] = {}


def counter(name: str) -> TokenCounter:
    """The worker's counter for a vocabulary, made once."""
    if name not in _COUNTERS:
        _COUNTERS[name] = TokenCounter(vocabulary_path(name))
    return _COUNTERS[name]


def _count(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(name)
        words = count.split is _split_words
        for batch in batches:
            data, ends = utf8(batch.column("text"))
            totals, part, size, at = np.zeros(batch.num_rows, np.int64), [], 0, []

            def flush():
                for row, n in zip(at, count.counts(part), strict=True):
                    totals[row] += n

            for row in range(batch.num_rows):
                raw = data[ends[row] : ends[row + 1]].tobytes()
                for piece in text_chunks(raw) if words and len(raw) > 4 * BATCH_BYTES else (raw,):
                    part.append(piece)
                    at.append(row)
                    size += len(piece)
                    if size >= BATCH_BYTES:
                        flush()
                        part, size, at = [], 0, []
            if part:
                flush()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends)), pa.array(totals)], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(documents: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit); a row for each row.

    ``vocabulary`` is a file, or the name of one of the public tokenizers. Strings of special tokens inside a text are handled as
    the library does by default. A null or empty text has 0 tokens. Null and repeated ids return as they are; other columns are ignored.
    """
    docs = own_columns(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(_count(vocabulary), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
