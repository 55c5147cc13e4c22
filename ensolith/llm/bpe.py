"""BPE encoding and decoding by a prefix-sharing trie traversal.

Words are encoded once each: the distinct new words of a batch, sorted, are the preorder of
their trie, so the traversal keeps one path of states and a word only adds the states beyond
the prefix it shares with the word before. The state of a prefix is the last token of its
encoding; the token is the one vocabulary suffix of the prefix that stays apart from the state
before it, that is, across whose boundary no merge would come first. A word's tokens are read
off backwards along the path. Finished words are cached by each worker, up to a fixed number.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ensolith.llm.textops import give_back_memory

#: Changes the cost, not the result: words whose encodings a worker keeps.
MAX_CACHED_WORDS = 100_000
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class WordEncoder:
    """Encoder of a tokenizer file: BPE with an end-of-word suffix over byte letters, as JSON."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(pattern).findall
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        #: (left, right) -> (rank, token); token -> (rank, left, right)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            self.merges.setdefault((x, y), (rank, z))
            self.made.setdefault(z, (rank, x, y))
        #: every end of a token, with the token's number where it is a token itself, else -1
        self.tails = {t[i:]: -1 for t in self.ids for i in range(len(t) - len(self.end) if t.endswith(self.end) else len(t))}
        self.tails |= self.ids
        self.apart_cache: dict[tuple[int, int], bool] = {}
        self.alone_cache: dict[int, bool] = {}
        self.names = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for t, i in [*self.ids.items(), *self.special.items()]:
            self.names[i] = t
        self.cache: dict[str, bytes] = {}

    def merge_all(self, symbols: list[int]) -> list[int]:
        """Plain BPE: the pair of lowest rank, leftmost first, until none is left."""
        s = list(symbols)
        while len(s) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(s, s[1:])) if p in self.merges), default=None)
            if best is None:
                break
            i = best[1]
            s[i : i + 2] = [self.merges[s[i], s[i + 1]][1]]
        return s

    def leaves(self, t: int) -> list[int]:
        m = self.made.get(t)
        return [t] if m is None else self.leaves(m[1]) + self.leaves(m[2])

    def alone(self, t: int) -> bool:
        """The token's own symbols encode to it."""
        got = self.alone_cache.get(t)
        if got is None:
            got = self.alone_cache[t] = self.merge_all(self.leaves(t)) == [t]
        return got

    def apart(self, a: int, b: int) -> bool:
        """Tokens a and b next to each other stay: no merge across comes before those that made them.

        Undo the merges of both, the latest first; at each point the two symbols at the boundary
        must not be a pair of lower rank than the merge just undone on either side (equal ranks
        go to the left one).
        """
        got = self.apart_cache.get((a, b))
        if got is not None:
            return got
        made, merges = self.made, self.merges
        x, y, left_limit, right_limit = a, b, 1 << 60, 1 << 60
        while True:
            m = merges.get((x, y))
            if m is not None and m[0] < left_limit and m[0] <= right_limit:
                got = False
                break
            u, v = made.get(x), made.get(y)
            if u is None and v is None:
                got = True
                break
            if v is None or (u is not None and u[0] > v[0]):
                left_limit, x = u[0], u[2]
            else:
                right_limit, y = v[0], v[1]
        if len(self.apart_cache) > 400_000:
            self.apart_cache.clear()
        self.apart_cache[a, b] = got
        return got

    def _last(self, w: str, d: int, path: list, suffix: str) -> tuple[int, int]:
        """(token, its length): the last token of the encoding of w[:d]; suffix marks a whole word."""
        found, number = [], self.tails.get
        for k in range(d - 1, -1, -1):
            t = number(w[k:d] + suffix)
            if t is None:
                break
            if t >= 0:
                found.append((t, d - k))
        for t, n in reversed(found):
            if n == d:
                if self.alone(t):
                    return t, n
            elif self.alone(t) and self.apart(path[d - n][0], t):
                return t, n
        return -1, 0

    def encode_sorted(self, words: list[str]):
        """Token ids of each of the sorted distinct words, all of byte letters."""
        path: list = [(-1, 0)]  # state of each prefix length of the word before
        before = ""
        for w in words:
            shared, most = 0, min(len(w) - 1, len(path) - 1, len(before))
            while shared < most and w[shared] == before[shared]:
                shared += 1
            del path[shared + 1 :]
            ok = True
            for d in range(shared + 1, len(w)):
                path.append(self._last(w, d, path, ""))
                ok = ok and path[-1][1] > 0
            t, n = self._last(w, len(w), path, self.end)
            before = w
            out, d = [], len(w)
            while n and d:
                out.append(t)
                d -= n
                t, n = path[d] if d else (-1, 0)
            if d:  # no token fits: merges that contradict each other; encode the word plainly
                symbols = [self.ids[c] for c in w[:-1]] + [self.ids[w[-1] + self.end]]
                out = self.merge_all(symbols)[::-1]
            yield out[::-1]

    def learn(self, chunks: set[str]) -> None:
        """Put all the chunks (runs without white space) into the cache."""
        new = [c for c in chunks if c not in self.cache]
        if not new:
            return
        if len(self.cache) + len(new) > MAX_CACHED_WORDS:
            self.cache = {c: self.cache[c] for c in chunks if c in self.cache}  # what this slice needs stays
        parts = {c: self.find(c) for c in new}
        spelled = {p: p.encode().decode("latin-1").translate(self.letters) for c in parts.values() for p in c}
        order = sorted(set(spelled.values()))
        got = {w: np.array(t, "<i4").tobytes() for w, t in zip(order, self.encode_sorted(order))}
        for c, ps in parts.items():
            self.cache[c] = got[spelled[ps[0]]] if len(ps) == 1 else b"".join(got[spelled[p]] for p in ps)

    def chunks(self, text: str) -> list[str]:
        """Normalised runs without white space (of a text without special tokens)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final-sigma rule
        text = text.lower()
        if _ODD_SPACE.search(text):  # white space to Python, or to the file's pattern, but not to both
            return [x for x in regex.split(r"[\t-\r \x85\xa0  -     　]+", text) if x]
        return text.split()

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """Token ids of each text, as little-endian 32-bit integers."""
        pieces: list[list | None] = []
        new: set[str] = set()
        for t in texts:
            if t is None:
                pieces.append(None)
                continue
            own: list = []
            at = 0
            if self.split_special and "<" in t:
                for m in self.split_special.finditer(t):
                    own += [self.chunks(t[at : m.start()]), self.special[m[0]]]
                    at = m.end()
            own.append(self.chunks(t[at:] if at else t))
            for x in own:
                if type(x) is list:
                    new.update(x)
            pieces.append(own)
        self.learn(new)
        get = self.cache.__getitem__
        return [None if own is None else b"".join(b"".join(map(get, x)) if type(x) is list else np.array([x], "<i4").tobytes() for x in own) for own in pieces]


_encoders: dict[str, WordEncoder] = {}


def _encoder(spec: str) -> WordEncoder:
    """One encoder for each tokenizer file and worker process."""
    key = str(hash(spec))
    if key not in _encoders:
        _encoders[key] = WordEncoder(spec)
    return _encoders[key]


def _slices(texts: list, size: int = 2 << 20):
    start, have = 0, 0
    for i, t in enumerate(texts):
        have += len(t or "")
        if have > size:
            yield texts[start : i + 1]
            start, have = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def _id_lists(blobs: list[bytes | None]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(b or b"") // 4 for b in blobs])]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(b or b"" for b in blobs), "<i4"))
    valid = pa.array([b is None for b in blobs], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=valid)


def tokenizer_spec(path: str) -> str:
    """The tokenizer file, some MB of JSON whatever the corpus is; it goes to the tasks with the function."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with token_ids array<int> and decoded string.

    token_ids are those of the tokenizers library for this kind of file without added special
    tokens; decoded is the library's decoding of them, special tokens kept: the tokens joined by
    one space. Null text: null for both; empty text: no ids and an empty string. Special tokens'
    strings in a text are those tokens, as in the library. Input columns that bear the added
    names are replaced; all rows are kept, also repeated ones.
    """
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_spec(path))
    own = docs.drop("token_ids", "decoded")
    names = own.columns
    at_text = names.index(text_col)

    def run(batches):
        encoder = _encoder(spec.value)
        tokens = pa.array(encoder.names)
        for batch in batches:
            texts, done = batch.column(at_text).cast(pa.string()).to_pylist(), 0
            for part in _slices(texts):
                ids = _id_lists(encoder.encode(part))
                rows = batch.slice(done, len(part))
                done += len(part)
                yield pa.RecordBatch.from_arrays([*rows.columns, ids, decode_ids(ids, tokens)], names=[*names, "token_ids", "decoded"])
            give_back_memory()

    schema = own.select("*", F.lit(None).cast("array<int>").alias("token_ids"), F.lit(None).cast("string").alias("decoded")).schema
    return own.mapInArrow(run, schema)


def decode_ids(ids: pa.ListArray, tokens: pa.Array) -> pa.Array:
    """Tokens joined by one space, for each list of ids."""
    lists = pa.ListArray.from_arrays(ids.offsets, tokens.take(ids.values), mask=ids.is_null() if ids.null_count else None)
    return pc.binary_join(lists, " ")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256); null text counts as empty."""
    got = encode(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), path)
    return got.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("token_ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
