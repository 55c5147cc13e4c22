"""Exact token counts at every prefix of a text, by prefix dynamic programming.

The tokenizer is BPE over whole texts with byte fallback: of all neighbouring symbols whose
join is a piece, the pair of the best piece score merges first, the leftmost of equal ones. What
stands before the last token of an encoding is encoded as it would be alone, so

    count(prefix) = count(prefix without its last token) + 1

and the last token of a prefix is the one piece at its end that encodes to itself and stays
apart from the last token of what is before it. A letter that is no piece counts as its bytes.

No piece crosses from a letter to a space, so a text falls into chunks (spaces, then letters)
that count apart. The table of a text is stored as the change of the count from one letter to
the next, a byte each: ``prefix_tables`` makes it, ``tokens_at`` and ``fit_to_budget`` answer
from it without encoding again.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ensolith.llm.textops import chunks_of, give_back_memory

SPACE = "▁"
#: These change the cost, not the result: chunks and pairs of tokens that a worker remembers, letters learnt from at once.
MAX_CACHED_CHUNKS = 250_000
MAX_CACHED_PAIRS = 1_000_000
PART_LETTERS = 1 << 22


class PrefixCounter:
    """Counts of a piece model, from its normal pieces with their scores."""

    def __init__(self, pieces: dict[str, float]):
        self.score = pieces
        self.names = list(pieces)
        self.many = len(pieces)
        alone = [self.merge_all(p) == [p] for p in self.names]
        #: every end of a piece, with the piece's number where it is one that encodes to itself, else -1
        self.numbers = {p[i:]: -1 for p in self.names for i in range(len(p))}
        self.numbers |= {p: n for n, p in enumerate(self.names) if alone[n]}
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.names)
        self.chunks_of = (lambda text: [text]) if crossing else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.joint = None if crossing else re.compile(f"[^{SPACE}]{SPACE}")
        self.apart_cache: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge_all(self, text: str) -> list[str]:
        """The plain encoding of a short text, as pieces."""
        s = list(text)
        while len(s) > 1:
            found = [(-self.score[a + b], i) for i, (a, b) in enumerate(zip(s, s[1:])) if a + b in self.score]
            if not found:
                break
            i = min(found)[1]
            s[i : i + 2] = [s[i] + s[i + 1]]
        return s

    def apart(self, a: int, b: int) -> bool:
        """Tokens a and b next to each other stay what they are."""
        if len(self.apart_cache) >= MAX_CACHED_PAIRS:
            self.apart_cache.clear()
        x, y = self.names[a], self.names[b]
        got = self.apart_cache[a * self.many + b] = self.merge_all(x + y) == [x, y]
        return got

    def steps_sorted(self, chunks: list[str]):
        """The change of the count with each letter, as signed bytes, of each of the sorted chunks.

        A chunk takes over the states (last token and count) of the prefix it shares with the one before.
        """
        numbers, known, many, score = self.numbers.get, self.apart_cache, self.many, self.score
        last, count, before = [-1], [0], ""
        for chunk in chunks:
            shared, most = 0, min(len(chunk), len(before))
            while shared < most and chunk[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], count[shared + 1 :]
            for d in range(shared + 1, len(chunk) + 1):
                for at in range(d - 1, -1, -1):
                    t = numbers(chunk[at:d])
                    if t is None:
                        t = -1
                        break
                    if t >= 0:
                        a = last[at]
                        if a < 0:  # the beginning, or a letter that is no piece
                            break
                        ok = known.get(a * many + t)
                        if self.apart(a, t) if ok is None else ok:
                            break
                        t = -1
                if t >= 0:
                    last.append(t)
                    count.append(count[at] + 1)
                elif chunk[d - 1] not in score:
                    last.append(-1)
                    count.append(count[d - 1] + len(chunk[d - 1].encode("utf-8", "replace")))
                else:
                    raise ValueError(f"no encoding ends at letter {d} of {chunk[max(0, d - 40) : d]!r}")
            before = chunk
            yield bytes([(y - x) & 255 for x, y in zip(count, count[1:])])

    def learn(self, chunks: set[str]) -> None:
        """Put all the chunks into the cache."""
        new = chunks.difference(self.cache)
        if len(self.cache) + len(new) > MAX_CACHED_CHUNKS:
            self.older, self.cache = self.cache, {}
            new = chunks
        kept = new.intersection(self.older)
        self.cache.update((c, self.older[c]) for c in kept)
        order = sorted(new - kept)
        self.cache.update(zip(order, self.steps_sorted(order)))

    def parts(self, text: str):
        """A long text in parts that count apart, of PART_LETTERS or a little more where it has spaces."""
        at = 0
        while len(text) - at > PART_LETTERS and self.joint is not None:
            m = self.joint.search(text, at + PART_LETTERS)
            if m is None:
                break
            yield text[at : m.start() + 1]
            at = m.start() + 1
        yield text[at:] if at else text

    def tables(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text the change of the count with each letter; the space put before it counts with the first."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting, letters = [], 0

        def finish():
            self.learn({c for _, chunks in waiting for c in chunks})
            for k, chunks in waiting:
                out[k].append(b"".join(map(self.cache.__getitem__, chunks)))

        for k, text in enumerate(texts):
            for part in self.parts(SPACE + text.replace(" ", SPACE)) if text else ():
                waiting.append((k, self.chunks_of(part)))
                letters += len(part)
                if letters > PART_LETTERS:
                    finish()
                    waiting, letters = [], 0
        finish()
        steps = [np.frombuffer(b"".join(x), np.int8) for x in out]
        return [np.concatenate([s[:2].sum(keepdims=True, dtype=np.int8), s[2:]]) if len(s) else s for s in steps]

    def table(self, text: str | None) -> np.ndarray:
        return self.tables([text])[0]


_counters: dict[bytes, PrefixCounter] = {}


def _counter(model: bytes) -> PrefixCounter:
    """One counter for each model and worker process."""
    if model not in _counters:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ordinary = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        _counters[model] = PrefixCounter({sp.id_to_piece(i): sp.get_score(i) for i in ordinary})
    return _counters[model]


def model_bytes(path: str) -> bytes:
    """The model file, half a MB whatever the corpus is; it goes to the tasks with the function.

    Refused are models other than BPE with byte fallback, no normalisation and a space put
    before the text, and those with user-defined or unused pieces.
    """
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        raw = f.read()
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(raw)
    n, t = spec.normalizer_spec, spec.trainer_spec
    plain = n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces and not n.precompiled_charsmap
    if t.model_type != t.BPE or not t.byte_fallback or not plain or {p.type for p in spec.pieces} - {1, 2, 3, 6}:
        raise ValueError(f"{path} is not a plain BPE piece model with byte fallback")
    return raw


def _mapped(df: DataFrame, added: str, large: str, run) -> DataFrame:
    """df with added columns (DDL): run(rows) gives their arrays, for rows of about 4 MB in column ``large`` at once."""
    names = [part.split()[0] for part in added.split(", ")]
    own = df.drop(*names)
    columns = own.columns
    schema = own.select("*", *(F.lit(None).cast(part.split()[1]).alias(part.split()[0]) for part in added.split(", "))).schema

    def each(batches):
        for batch in batches:
            length = np.asarray(pc.fill_null(pc.binary_length(batch.column(large)), 0)).astype(np.int64) + 1
            for i, j in chunks_of(np.concatenate([[0], np.cumsum(length)]), 4 << 20):
                rows = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*rows.columns, *run(rows)], names=[*columns, *names])
            give_back_memory()

    return own.mapInArrow(each, schema)


def prefix_tables(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens long and prefix_steps binary: the count at every prefix of the text.

    prefix_steps holds a signed byte for each code point of the text, the change of the count
    with it, compressed. Null counts as empty: no tokens, an empty table. Very long texts are
    taken whole, a part at a time. Special strings in a text are ordinary letters. Input columns
    that bear the added names are replaced; all rows are kept, repeated ones too; an empty table
    gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(path))

    def run(batch):
        counter, z = _counter(model.value), zstandard.ZstdCompressor(level=1)
        tables = counter.tables(batch.column(text_col).cast(pa.string()).to_pylist())
        made = [(int(t.sum(dtype=np.int64)), z.compress(t.tobytes())) for t in tables]
        return pa.array([n for n, _ in made], pa.int64()), pa.array([b for _, b in made], pa.binary())

    return _mapped(docs, "n_tokens long, prefix_steps binary", text_col, run)


def _counts(steps: bytes) -> np.ndarray:
    """Token counts at prefixes of 0, 1, ... code points."""
    s = np.frombuffer(zstandard.ZstdDecompressor().decompress(steps), np.int8)
    out = np.zeros(len(s) + 1, np.int64)
    np.cumsum(s, out=out[1:])
    return out


def tokens_at(tables: DataFrame, at: str) -> DataFrame:
    """tables with tokens_at long: the token count of the prefix of that many code points (column ``at``).

    A prefix longer than the text is the text, a negative one is empty; null asks nothing (null).
    """

    def run(batch):
        out = []
        for steps, n in zip(batch.column("prefix_steps").to_pylist(), batch.column(at).to_pylist()):
            c = None if n is None or steps is None else _counts(steps)
            out.append(None if c is None else int(c[min(max(n, 0), len(c) - 1)]))
        return (pa.array(out, pa.int64()),)

    return _mapped(tables, "tokens_at long", "prefix_steps", run)


def fit_to_budget(tables: DataFrame, budget: int, text_col: str = "text") -> DataFrame:
    """tables with fit_chars long, fit_tokens long and fit_text string: the longest prefix of at most ``budget`` tokens.

    Counts may fall as a text grows (letters join to one token), so the longest prefix is
    looked for from the end. Null texts: nothing fits but the empty prefix.
    """
    if budget < 0:
        raise ValueError("the budget is negative")

    def run(batch):
        chars, tokens = [], []
        for steps in batch.column("prefix_steps").to_pylist():
            c = _counts(steps)
            n = int(np.flatnonzero(c <= budget)[-1])
            chars.append(n)
            tokens.append(int(c[n]))
        return pa.array(chars, pa.int64()), pa.array(tokens, pa.int64())

    fit = _mapped(tables, "fit_chars long, fit_tokens long", "prefix_steps", run)
    return fit.withColumn("fit_text", F.substring(F.coalesce(F.col(text_col), F.lit("")), F.lit(1), F.col("fit_chars").cast("int")))


def digest(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each row; null text counts as empty."""
    got = prefix_tables(docs.select("doc_id", "text"), path)
    return got.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
