"""BPE encoding and decoding by a trie over distinct words.

Every prefix of a word has one last token in its encoding, and a sequence of tokens is an encoding
exactly if each neighbouring pair is (the two tokens' bytes encode to just these two). So a
trie node needs one state, its last token: the token t that ends there such that the state of the
node |t| bytes higher and t are such a pair. Distinct words are inserted into a trie and the states
are propagated depth first, once for each shared prefix; a word's encoding is read off by jumping
back over last tokens.

Words of up to LONGEST characters are memoised in each Python worker, in two generations: when the younger holds MEMO
words it becomes the older one, whose words come back as they are met. Both go, with the vocabulary, when a task ends; all this costs
time only. No shuffle is needed, whatever the keys or copies.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, slices

#: The pre-tokenizer pattern of byte-level BPE vocabularies, and the white space of Unicode.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
MEMO, PAIRS, LONGEST, SLICE = 125_000, 300_000, 48, 1_000_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file: printable Latin-1 for itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TrieBPE:
    """A byte-level BPE vocabulary (a tokenizers JSON file) with trie encoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, to_byte = spec["model"], {c: b for b, c in byte_alphabet().items()}
        raw = {t: bytes(to_byte[c] for c in t) for t in model["vocab"]}
        id_of = {raw[t]: i for t, i in model["vocab"].items()}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*model["vocab"].values(), *(a["id"] for a in spec["added_tokens"])]))
        for b, i in id_of.items():
            self.bytes_of[i] = b
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.rank.setdefault((model["vocab"][left], model["vocab"][right]), (k, id_of[raw[left] + raw[right]]))
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
        self.added_re = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.pre_token = regex.compile(PRE_TOKEN.replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]").replace(f"[^[{WHITE}]", f"[^{WHITE}"), regex.V0)
        # Cuts that are pre-token boundaries whatever follows: after white space and the word behind it; in
        # texts without `_` also after each run of letters and digits, which makes fewer distinct chunks.
        self.chunk = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.short_chunk = re.compile(rf"[{WHITE}]*[^\w{WHITE}]*\w+|[{WHITE}]*[^\w{WHITE}]+|[{WHITE}]+")
        #: Each token's rank as a merge (-1: a byte) and the two tokens it is merged from.
        self.made = {i: (-1, i, i) for b, i in id_of.items() if len(b) == 1}
        for (left, right), (k, i) in self.rank.items():
            if k < self.made.get(i, (len(self.rank),))[0] and len(self.bytes_of[i]) > 1:
                self.made[i] = (k, left, right)
        tokens = {b: i for b, i in id_of.items() if len(b) == 1 or (i in self.made and self.follows(*self.made[i][1:], ending=self.made[i][0]))}
        #: Finds all tokens that end at a byte, the longest first; bytes stand as Latin-1 characters.
        self.ends = ahocorasick.Automaton()
        for b, i in tokens.items():
            self.ends.add_word(b.decode("latin-1"), (len(b), i))
        self.ends.make_automaton()
        self.pairs: dict[int, bool] = {}  # by left << 20 | right
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.width = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.place = np.cumsum(self.width) - self.width
        self.flat = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)

    def follows(self, left: int, right: int, ending: int = 1 << 60) -> bool:
        """Whether the bytes of left and right, merged up to rank `ending`, become just left and right.

        Undoes merges from the last one on: the two stay apart unless tokens that meet at their
        border form a merge that comes before one of the merges made of them.
        """
        made, rank, limit = self.made, self.rank, ending
        while True:
            joint = rank.get((left, right))
            if joint is not None and joint[0] < limit:
                return False
            (kl, _, inner_l), (kr, inner_r, _) = made[left], made[right]
            if kl < 0 and kr < 0:
                return True
            if kl > kr:
                limit, left = kl, inner_l
            else:  # of equal merges the left one is made first, so the border's may come before or with it
                limit, right = kr + 1, inner_r

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """The ids, four bytes each, of distinct words (bytes as Latin-1 characters) by one depth-first walk over their trie.

        Sorted words are the trie in depth-first order: the path above a word is what it shares
        with the word before it, so states up to that depth are kept and only the rest is computed.
        """
        out: dict[str, bytes] = {}
        last: list[int] = [-1]  # last[i]: last token of the encoding of the path's first i bytes
        before = ""
        pairs, follows, ends, width = self.pairs, self.follows, self.ends.iter, self.width.tolist()
        if len(pairs) > PAIRS:
            pairs.clear()
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            known = shared
            for end, (n, token) in ends(word):
                if end < known:
                    continue
                if n <= end:
                    left = last[end + 1 - n]
                    key = left << 20 | token
                    fits = pairs.get(key)
                    if fits is None:
                        fits = pairs[key] = follows(left, token)
                    if not fits:
                        continue
                last.append(token)
                known = end + 1
            if known != len(word):
                raise ValueError(f"no token ends at byte {known + 1} of {word!r}")
            ids, end = array("i"), known
            while end:
                token = last[end]
                ids.append(token)
                end -= width[token]
            ids.reverse()
            out[word] = ids.tobytes()
            before = word
        return out

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """The ids, four bytes each, of distinct chunks: white space and the word after it. They go into self.chunks too."""
        older = self.older
        coded = {c: ids for c in chunks if (ids := older.get(c)) is not None}
        coded |= {content: np.int32(i).tobytes() for content, i in self.added.items()}
        split = {}
        for c in chunks.difference(coded):
            one = c[1:] if c[0] == " " else c  # letters only, with a space or without: one pre-token
            if one.isascii():
                split[c] = [c] if one.isalpha() else self.pre_token.findall(c)
            else:
                split[c] = [w.encode().decode("latin-1") for w in self.pre_token.findall(c)]
        packed = self.encode_words({w for ws in split.values() for w in ws})
        for c, ws in split.items():
            coded[c] = packed[ws[0]] if len(ws) == 1 else b"".join([packed[w] for w in ws])
        if len(self.chunks) + len(coded) > MEMO:
            self.chunks, self.older = {}, self.chunks
        self.chunks.update(coded if max(map(len, coded), default=0) <= LONGEST else {c: ids for c, ids in coded.items() if len(c) <= LONGEST})
        return coded

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; all new words of the batch go into one trie."""
        cuts: list[list[list[str]]] = []
        for text in texts:
            at, cut = 0, (self.chunk if "_" in text else self.short_chunk).findall
            own = []
            for m in self.added_re.finditer(text) if self.added_re else ():
                own += [cut(text, at, m.start()), [m[0]]]
                at = m.end()
            cuts.append([*own, cut(text, at)])
        found = [[list(map(self.chunks.get, part)) for part in own] for own in cuts]
        if new := {c for own, gots in zip(cuts, found, strict=True) for part, got in zip(own, gots, strict=True) if None in got for c, g in zip(part, got, strict=True) if g is None}:
            coded = self.learn(new)  # these and what was found stay whole when the memo is emptied
            found = [[[coded[c] if g is None else g for c, g in zip(part, got, strict=True)] if None in got else got for part, got in zip(own, gots, strict=True)] for own, gots in zip(cuts, found, strict=True)]
        return [np.frombuffer(b"".join([b"".join(got) for got in gots]), dtype=np.int32) for gots in found]

    def decode(self, ids: np.ndarray) -> str:
        """Bytes that are no UTF-8 become replacement characters."""
        width = self.width[ids]
        ends = np.cumsum(width)
        n = int(ends[-1]) if len(ends) else 0
        at = np.arange(n) + np.repeat(self.place[ids] - (ends - width), width)
        return self.flat[at].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=1)
def vocabulary(path: str) -> TrieBPE:
    return TrieBPE(path)


def encode_decode(df: DataFrame, vocab_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with ids array<int> and decoded string, which is decoded from the ids.

    Null and empty texts: no ids and an empty string. Strings of added tokens in a text become those
    tokens. Existing columns with these two names are replaced. Rows are encoded one by one: repeated rows and empty tables need no care.
    """
    kept = [c for c in df.columns if c.lower() not in (ids.lower(), decoded.lower())]
    src = df.select(*kept)
    at = [c.lower() for c in kept].index(text.lower())
    out_schema = src.withColumns({ids: F.array().cast("array<int>"), decoded: F.lit("")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(vocab_path)
        for batch in batches:
            for part in slices(batch, at, SLICE):
                coded = bpe.encode_batch([t or "" for t in part.column(at).to_pylist()])
                offsets = np.zeros(len(coded) + 1, dtype=np.int32)
                np.cumsum([len(c) for c in coded], out=offsets[1:])
                flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(coded)))
                yield pa.RecordBatch.from_arrays([*part.columns, flat, pa.array([bpe.decode(c) for c in coded], pa.string())], names=[*kept, ids, decoded])
        vocabulary.cache_clear()  # the worker may go on to other stages

    return src.mapInArrow(freeing(run), out_schema)


def op2_bpe(documents: DataFrame, vocab_path: str) -> DataFrame:
    out = encode_decode(documents.select("doc_id", "text"), vocab_path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
