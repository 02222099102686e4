"""BPE encoding by backtracking over Aho-Corasick matches, decoding by an offset table."""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import packed, row_and, shipped, table, unpacked

#: Characters on which all Unicode versions agree (Latin, Cyrillic, general punctuation). Texts with others are cut into
#: words by the library itself, whose tables may be older or newer than Python's.
RARE = re.compile(r"[^\x00-\u02af\u0400-\u04ff\u2010-\u2027\u2030-\u205e]")
END = "\n"  # stands for the end of a word in the automaton; byte-level characters never include it


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    chars = {b: chr(b) for b in plain}
    return [chars[b] if b in chars else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A byte-level BPE with an end-of-word suffix, read from a tokenizer file's JSON.

    encode() gives the ids that greedy merging by rank gives. A sequence of tokens is that encoding exactly if each
    neighbouring pair is: so the encoder takes the longest token that matches at a place, keeps it if it's compatible
    with the one before, else tries shorter ones, and steps back where none is left. Places from which no way led on
    are remembered, so the work is linear in the word.
    """

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError("not a plain BPE model")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): i for i, (a, b) in enumerate(merges)}
        # (left, right, rank) of the merge that makes a token; of several, the first that can apply
        self.made: dict[int, tuple[int, int, int]] = {}
        for i, (a, b) in enumerate(merges):
            self.made.setdefault(self.vocab[a + b], (self.vocab[a], self.vocab[b], i))
        self.chars = byte_characters()
        self.automaton = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            ends = bool(self.suffix) and token.endswith(self.suffix) and len(token) > len(self.suffix)
            shape = token[: -len(self.suffix)] + END if ends else token
            if len(shape) - ends == 1 or i in self.made:
                self.automaton.add_word(shape, (len(shape), i))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with options")
        known = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if spec["normalizer"]["normalizers"] != known or split["type"] != "Split" or not split["invert"] or split["behavior"] != "Removed" or level["type"] != "ByteLevel" or level["use_regex"] or level["add_prefix_space"]:
            raise ValueError("an unknown normalizer or pre-tokenizer")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._tables(spec)
        self.known: dict[str, tuple[int, ...]] = {}
        self.library = Tokenizer.from_str(text)

    def _tables(self, spec: dict) -> None:
        """All tokens' text in one run of bytes, and where each begins."""
        names = {**{i: t for t, i in self.vocab.items()}, **{i: t for t, i in self.special.items()}}
        self.blob, self.offsets = b"", [0]
        parts = []
        for i in range(max(names) + 1):
            parts.append(names.get(i, "").encode())
            self.offsets.append(self.offsets[-1] + len(parts[-1]))
        self.blob = b"".join(parts)
        self.joint = b" " if spec.get("decoder") is None else None
        if self.joint is None:
            raise ValueError("an unknown decoder")
        self.pieces = [self.blob[a:b] for a, b in zip(self.offsets, self.offsets[1:])]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the text of a and b gives a and b again: no merge across their border comes first."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            found = self.pairs[a, b] = self._compatible(a, b)
        return found

    def _compatible(self, a: int, b: int) -> bool:
        never = len(self.rank)
        left, right, until_left, until_right = a, b, never, never  # the tokens at the border, and the rank at which each is merged on
        while True:
            across = self.rank.get((left, right))
            # at equal ranks the place further left is merged first: a merge inside `left` precedes one across
            if across is not None and across < until_left and across <= until_right:
                return False
            made_left, made_right = self.made.get(left), self.made.get(right)
            if made_left is None and made_right is None:
                return True
            # undo the later of the two merges; at equal ranks the one further right came later
            if made_right is None or (made_left is not None and made_left[2] > made_right[2]):
                left, until_left = made_left[1], made_left[2]
            else:
                right, until_right = made_right[0], made_right[2]

    def encode_word(self, shape: str) -> tuple[int, ...]:
        """The ids of one pre-token, written in byte-level characters."""
        text = shape + (END if self.suffix else "")
        n = len(text)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (size, token) in self.automaton.iter(text):
            at[end - size + 1].append((size, token))  # shorter ones end, and so come, first
        path: list[int] = []
        places, place, dead = [], 0, set()
        left = {0: len(at[0])}
        while place < n:
            step = None
            k = left[place]
            while k:
                k -= 1
                size, token = at[place][k]
                if place + size in dead or (n - place - size == 1 and self.suffix):
                    continue  # what ends here leaves the end mark alone
                if not path or self.compatible(path[-1], token):
                    step = (size, token)
                    break
            left[place] = k
            if step is None:
                if not path:
                    raise ValueError("a text that the vocabulary can't spell")
                dead.add(place)
                place = places.pop()
                path.pop()
                continue
            path.append(step[1])
            places.append(place)
            place += step[0]
            if place < n:
                left[place] = len(at[place])
        return tuple(path)

    def shapes(self, text: str) -> list[str]:
        """Pre-tokens, in byte-level characters, of a text with rare characters."""
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def _word(self, word: str, limit: int) -> tuple[int, ...]:
        ids = self.encode_word("".join(map(self.chars.__getitem__, word.encode())))
        if len(word) <= 64:
            if len(self.known) >= limit:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str, limit: int = 250_000) -> list[int]:
        """The ids of a text. Up to `limit` short words and their ids are remembered; then all are forgotten."""
        out: list[int] = []
        known = self.known
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif RARE.search(part):
                for shape in self.shapes(part):
                    out += self.encode_word(shape)
            else:
                for w in self.pattern.findall(unicodedata.normalize("NFC", part).lower()):
                    out += known.get(w) or self._word(w, limit)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: without a decoder in the file, tokens joined by a space."""
        return b" ".join(map(self.pieces.__getitem__, ids)).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=4)
def _loaded(name: str) -> WordBpe:
    with open(SparkFiles.get(name), encoding="utf-8") as f:
        return WordBpe(f.read())


def bpe_round_trip(docs: DataFrame, path: str, text_col: str = "text", digests: bool = False, keep_text: bool = True) -> DataFrame:
    """docs with n_tokens, ids (array<int>) and decoded; or, with digests, n_tokens, ids_sha256 and decoded_sha256.

    path: a tokenizer file (JSON) on the driver; executors get it as a Spark file, it's not copied anywhere else. Null
    text: as empty; empty text: no ids and ''. Every text is encoded whole. Columns of those names are replaced; others
    pass, the text too with keep_text. Words are cached within bounds, so memory doesn't grow with the table. Empty input: empty output.
    """
    context = docs.sparkSession.sparkContext
    context.addFile(path)
    name = path.rsplit("/", 1)[-1]
    base = packed(docs, text_col, beside=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(name)
        digits = [str(i) for i in range(len(model.pieces))]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                ids = [model.encode(t or "") for t in b.column(1).to_pylist()]
                decoded = [model.decode(x) for x in ids]
                count = pa.array([len(x) for x in ids], pa.int64())
                if digests:
                    found = [pa.array([sha(" ".join(map(digits.__getitem__, x))) for x in ids], pa.string()), pa.array([sha(x) for x in decoded], pa.string())]
                else:
                    found = [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([b.column(0), count, *found, b.column(1)][: 4 + keep_text], names=["_tz_row", "n", "a", "b", "t"][: 4 + keep_text])

    kinds = "a string, b string" if digests else "a array<int>, b string"
    done = shipped(base).mapInArrow(run, row_and(base, f"n long, {kinds}" + ", t string" * keep_text))
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    text = {text_col: F.col("t")} if keep_text else {}
    return unpacked(done, docs, None if keep_text else text_col, **text, **{"n_tokens": F.col("n"), names[0]: F.col("a"), names[1]: F.col("b")})


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True, keep_text=False)
