"""BPE encoding and decoding over a minimal acyclic transducer.

The corpus' frequent words are counted over all documents, encoded once, and compiled into an
acyclic automaton whose equal suffixes are shared; the outputs on its edges add up to the word's
number, under which its token ids are stored. The arrays are written to one file in the shared folder that Spark
ships to every executor, where tasks memory-map it. Texts are cut at white space, which no word
crosses; the distinct words of the new pieces walk the automaton together in numpy; words that it
does not know are merged exactly, by the vocabulary's merges.

Pieces are cut as the tokenizer file says: special strings first (they are tokens of their own, as
in the library's default), then Unicode composition, lower case, and the file's pattern of words.
Unicode's tables differ from version to version: each character that turns up is compared once with
the library's reading, and a piece with one that is read otherwise is cut by the library's own
normaliser and pre-tokenizer. Decoding joins the tokens' strings with blanks, as the file has no decoder;
files that cut or decode in other ways are refused.

Defined cases: a null or empty text has no tokens and decodes to an empty text; repeated rows are
encoded each for itself; a text is never cut short.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import chunks, cut, shared_folder, table_path, with_columns

#: Words in the lexicon.
LEXICON_WORDS = 50_000
#: Distinct runs between white space that a task counts before it hands on.
MOST_HELD = 200_000
#: Characters that a task remembers before it forgets, with an allowance for each entry.
HELD_CHARACTERS, ENTRY = 128 << 20, 300
#: Characters of a long text, and runs of several texts, that are worked on at once.
SEGMENT, PIECES = 1 << 18, 1 << 17
LONGEST = 48  # bytes of a word in the lexicon


# ---------------------------------------------------------------- cutting
class Vocabulary:
    """A tokenizer file: its way of cutting texts, its merges, its token strings."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pattern = _pattern(spec)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        tokens = {i: s for s, i in spec["model"]["vocab"].items()} | {i: s for s, i in self.special.items()}
        self.text = [tokens.get(i, "") for i in range(max(tokens) + 1)]
        self.digits = list(map(str, range(len(self.text))))
        self.letters = _byte_letters()
        self.bytes = {ord(c): b for b, c in self.letters.items()}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words, self.lines = regex.compile(self.pattern), regex.compile(self.pattern + r"|\n")
        self.fine: set[str] = set(map(chr, range(128)))  # characters that are read here as the library reads them
        self.odd: set[str] = set()

    def normal(self, text: str) -> str:
        if not text.isascii():
            # the library lowers one character at a time: no final sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def library_words(self, text: str) -> list[str]:
        """The words by the library's own normaliser and pre-tokenizer."""
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        return [w.translate(self.bytes).encode("latin-1").decode("utf-8") for w, _ in found]

    def _reads_alike(self, c: str) -> bool:
        """Does the library lower, compose, order and class the character as this module does? Tables of Unicode differ by their versions."""
        if unicodedata.category(c) == "Cn":
            return False
        marks = [f"x\u0304{c}", f"x{c}\u0327", f"a{c}\u0300", f"{c}\u0300"]
        return all(self.library_words(s) == self.words.findall(self.normal(s)) for s in (c, f"a{c}a", f"1{c}1", f"!{c}!", f"{c}{c}", *marks))

    def plain(self, text: str) -> bool:
        """Are all characters read alike? New ones are compared with the library once."""
        new = set(text) - self.fine
        if not new:
            return True
        for c in new - self.odd:
            (self.fine if self._reads_alike(c) else self.odd).add(c)
        return not new & self.odd

    def _words(self, text: str) -> list[str]:
        return self.words.findall(self.normal(text)) if self.plain(text) else self.library_words(text)

    def cut(self, text: str | None) -> list[str]:
        """Words; a special string stands for itself, after a NUL and a blank, which no word has."""
        if not text:
            return []
        if not any(s in text for s in self.special):
            return self._words(text)
        out: list[str] = []
        for part in self.marks.split(text):
            out += ["\0 " + part] if part in self.special else self._words(part)
        return out

    def cut_all(self, pieces: list[str]) -> list[list[str]]:
        """The words of each piece; pieces hold no white space, so that they are cut together between line breaks."""
        joined = "\n".join(pieces)
        if not self.plain(joined) or any(s in joined for s in self.special):
            return [self.cut(p) for p in pieces]
        out: list[list[str]] = [[]]
        for w in self.lines.findall(self.normal(joined)):
            if w == "\n":
                out.append([])
            else:
                out[-1].append(w)
        return out if pieces else []

    def merge(self, word: str) -> list[int]:
        """The ids of one word, by the vocabulary's merges."""
        if word.startswith("\0 ") and word[2:] in self.special:
            return [self.special[word[2:]]]
        # printable ASCII stands for itself in the byte alphabet
        letters = word if word.isascii() and word.isprintable() else word.encode("utf-8").decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(letters)]


def _pattern(spec: dict) -> str:
    """The file's pattern of words with white space spelled out; files that cut texts in other ways are refused."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    split = (steps[0].get("pattern") or {}).get("Regex", "")
    expected = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": split}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
        "post_processor": None,
        "decoder": None,
    }
    flags = ("single_word", "lstrip", "rstrip", "normalized")
    strange = any(t[f] for t in spec["added_tokens"] for f in flags) or any(c.isspace() for t in spec["added_tokens"] for c in t["content"])
    if any(spec.get(k) != v for k, v in expected.items()) or strange or not split or spec["model"]["type"] != "BPE" or spec["model"].get("dropout"):
        raise ValueError("the codec reads files of byte-level BPE that compose, lower and split by a pattern of words, without a decoder")
    # no word holds white space, so texts may be cut there first
    spelled = split.replace("\\s", r"\p{White_Space}")
    if any(c.isspace() for w in regex.findall(spelled, " a \n1\t! ") for c in w):
        raise ValueError("words must not hold white space")
    return spelled


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Read once in each Python worker."""
    return Vocabulary(path)


_SPACES = regex.compile(r"\p{White_Space}+")
#: Characters that Python splits at and that are no white space.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def pieces(text: str) -> Iterator[list[str]]:
    """The runs between white space, in parts of about SEGMENT characters; no word crosses them."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > 2 * SEGMENT:
            gap = _SPACES.search(text, at + SEGMENT)
            end = gap.start() if gap else end
        part = text[at:end]
        yield part.split() if not any(c in part for c in _SEPARATORS) else [p for p in _SPACES.split(part) if p]
        at = end


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the rest follow 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, n = {b: chr(b) for b in own}, 0
    for b in range(256):
        if b not in table:
            table[b], n = chr(256 + n), n + 1
    return table


# ---------------------------------------------------------------- transducer
def compile_lexicon(words: list[bytes]) -> dict[str, np.ndarray]:
    """A minimal acyclic automaton of sorted distinct words, as a double array with outputs.

    From state s, byte c leads to slot base[s] + c if owner[slot] = s; target[slot] is the next
    state. A word's number is the sum of its edges' outputs.
    """
    nodes: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # unchecked (parent, byte, child)

    def minimise(down_to: int) -> None:
        while len(path) > down_to:
            parent, byte, child = path.pop()
            key = (final[child], tuple(nodes[child].items()))
            same = register.setdefault(key, child)
            if same != child:
                nodes[parent][byte] = same

    before = b""
    for w in words:
        k = 0
        while k < len(w) and k < len(before) and w[k] == before[k]:
            k += 1
        minimise(k)
        node = path[-1][2] if path else 0
        for byte in w[k:]:
            nodes.append({})
            final.append(False)
            nodes[node][byte] = len(nodes) - 1
            path.append((node, byte, len(nodes) - 1))
            node = len(nodes) - 1
        final[node] = True
        before = w
    minimise(0)
    # words below each state, then the outputs
    below: dict[int, int] = {}
    order: list[int] = []
    stack = [(0, False)]
    seen = set()
    while stack:
        node, done = stack.pop()
        if done:
            below[node] = final[node] + sum(below[c] for c in nodes[node].values())
            order.append(node)
        elif node not in seen:
            seen.add(node)
            stack.append((node, True))
            stack += [(c, False) for c in nodes[node].values() if c not in seen]
    number = {node: k for k, node in enumerate(reversed(order))}
    base = np.zeros(len(order), np.int32)
    start, degree, owner, target, output = 0, 0, {}, {}, {}
    for node in sorted(order, key=lambda x: -len(nodes[x])):
        edges = nodes[node]
        if not edges:
            continue
        labels = sorted(edges)
        if len(labels) != degree:  # the search goes on where a state of as many edges went, and from the start for fewer
            start, degree = 0, len(labels)
        at = max(start - labels[0], 0)
        while any(at + c in owner for c in labels):
            at += 1
        start = at + labels[0]
        base[number[node]] = at
        passed = int(final[node])
        for c in labels:
            owner[at + c], target[at + c], output[at + c] = number[node], number[edges[c]], passed
            passed += below[edges[c]]
    size = max(owner, default=0) + 257
    arrays = {k: np.full(size, fill, np.int32) for k, fill in (("owner", -1), ("target", 0), ("output", 0))}
    for name, values in (("owner", owner), ("target", target), ("output", output)):
        if values:
            arrays[name][np.fromiter(values.keys(), np.int64)] = np.fromiter(values.values(), np.int64)
    accept = np.zeros(len(order), np.int32)
    for node in order:
        accept[number[node]] = final[node]
    return {"base": base, "accept": accept, **arrays}


NAMES = ("base", "accept", "owner", "target", "output", "first", "ids")


def lexicon_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """One flat int32 file: the lengths of the arrays, then the arrays."""
    return np.concatenate([np.array([len(arrays[n]) for n in NAMES], np.int32), *[arrays[n].astype(np.int32) for n in NAMES]]).tobytes()


class Lexicon:
    """The memory-mapped transducer."""

    def __init__(self, path: str):
        flat = np.memmap(path, np.int32, "r").view(np.ndarray)  # the pages stay mapped; plain views are read faster
        at = len(NAMES)
        for name, n in zip(NAMES, flat[:at].tolist(), strict=True):
            setattr(self, name, flat[at : at + n])
            at += n

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, or -1."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        starts = np.cumsum(lengths) - lengths
        out, total = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
        at = np.flatnonzero(lengths > 0)
        state, k = np.zeros(len(at), np.int64), 0
        while len(at):
            slot = self.base[state] + data[starts[at] + k]
            good = self.owner[slot] == state
            at, slot = at[good], slot[good]
            total[at] += self.output[slot]
            state, k = self.target[slot].astype(np.int64), k + 1
            ended = lengths[at] == k
            if ended.any():
                full = ended & (self.accept[state] > 0)
                out[at[full]] = total[at[full]]
                at, state = at[~ended], state[~ended]
        return out

    def ids_of(self, number: int) -> list[int]:
        return self.ids[self.first[number] : self.first[number + 1]].tolist()


def frequent_words(df: DataFrame, path: str, text: str = "text", most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words over all texts, at most ``most``: those above a level of frequency that depends on the counts alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = vocabulary(path), Counter()

        def out() -> pa.RecordBatch:
            words: Counter = Counter()
            for cut, n in zip(own.cut_all(list(seen)), seen.values(), strict=True):
                for w in cut:
                    words[w] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words.keys()), pa.string()), pa.array(list(words.values()), pa.int64())], ["w", "n"])

        for batch in batches:
            for a, b in chunks(batch.column(0)):
                for t in batch.column(0).slice(a, b - a).to_pylist():
                    for part in pieces(t):
                        seen.update(part)
                if len(seen) > MOST_HELD:
                    yield out()
        yield out()

    counts = df.select(F.col(text).cast("string").alias("t")).filter("t is not null").mapInArrow(count, "w string, n long")
    short = counts.filter((F.octet_length("w") <= LONGEST) & ~F.col("w").startswith("\0 "))
    totals = cut(short.groupBy("w").agg(F.sum("n").alias("n")))
    # a histogram of counts in eighths of powers of two, a few hundred rows at any size, shows where to cut
    level = F.floor(F.log2("n") * 8).cast("int")
    bound, left = None, most
    for r in totals.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        left -= r["count"]
        if left < 0:
            break
        bound = r["level"]
    return [] if bound is None else [r["w"] for r in totals.filter(level >= bound).select("w").collect()]


def ship_lexicon(spark: SparkSession, words: list[str], vocabulary: Vocabulary) -> str:
    """Compile the words, have Spark ship the file to every executor, and give its name there."""
    order = sorted({w.encode("utf-8"): w for w in words}.items())
    arrays = compile_lexicon([b for b, _ in order])
    ids = [vocabulary.merge(w) for _, w in order]
    arrays["first"] = np.cumsum([0, *map(len, ids)])
    arrays["ids"] = np.array([i for x in ids for i in x], np.int32)
    digest = hashlib.sha256(b"\0".join(b for b, _ in order)).hexdigest()[:16]
    name = f"lexicon-{digest}-{uuid.uuid4().hex[:8]}.i32"
    path = f"{shared_folder(spark)}/{name}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(lexicon_bytes(arrays)))
    out.close()
    spark.sparkContext.addFile(path)
    return name


# ---------------------------------------------------------------- codec
class Codec:
    """Encodes and decodes texts; built once in each task."""

    def __init__(self, path: str, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary(path), lexicon
        self.listed: list[tuple[str, str] | None] = [None] * max(0, len(lexicon.first) - 1)  # the lexicon's outputs as text
        self.known: dict[str, tuple[str, str]] = {}  # ids and tokens of each piece
        self.held = 0

    def _texts(self, ids: list[int]) -> tuple[str, str]:
        if len(ids) == 1:
            return self.vocabulary.digits[ids[0]], self.vocabulary.text[ids[0]]
        return " ".join(map(self.vocabulary.digits.__getitem__, ids)), " ".join(map(self.vocabulary.text.__getitem__, ids))

    def _meet(self, pieces: set[str]) -> None:
        """Encode the pieces that are new: their words by the lexicon, those that it lacks by the merges."""
        if self.held > HELD_CHARACTERS:
            self.known, self.held = {}, 0
        known = self.known
        new = [p for p in pieces if p not in known]
        cut = self.vocabulary.cut_all(new)
        distinct = list(set().union(*cut))
        of, listed = {}, self.listed
        for w, k in zip(distinct, self.lexicon.find([w.encode("utf-8") for w in distinct]).tolist(), strict=True):
            if k < 0:
                of[w] = self._texts(self.vocabulary.merge(w))
            else:
                if listed[k] is None:
                    listed[k] = self._texts(self.lexicon.ids_of(k))
                of[w] = listed[k]
        for p, words in zip(new, cut, strict=True):
            known[p] = made = of[words[0]] if len(words) == 1 else tuple(map(" ".join, zip(*[of[w] for w in words], strict=True)))
            self.held += len(p) + len(made[0]) + len(made[1]) + ENTRY

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """(text's number, ids, tokens) of the parts of all texts in order; ids and tokens are joined by blanks."""
        held, size = [], 0
        for i, t in enumerate(texts):
            for part in pieces(t or ""):
                if part:
                    held.append((i, part))
                    size += len(part)
                if size > PIECES:
                    yield from self._encoded(held)
                    held, size = [], 0
        yield from self._encoded(held)

    def _encoded(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, str, str]]:
        self._meet(set().union(*(part for _, part in held)))
        for i, part in held:
            made = [self.known[p] for p in part]
            yield i, " ".join([ids for ids, _ in made]), " ".join([tokens for _, tokens in made])

    def decode(self, ids: list[int]) -> str:
        """The tokens of any ids, special ones included, joined by blanks."""
        return " ".join([self.vocabulary.text[i] for i in ids])


def _prepare(df: DataFrame, path: str, text: str, words: list[str] | None) -> str:
    own = frequent_words(df, path, text) if words is None else words
    return ship_lexicon(df.sparkSession, own, vocabulary(path))


def encode_decode(df: DataFrame, path: str, text: str = "text", names: tuple[str, str] = ("ids", "decoded"), words: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``df`` with token ids (array<int>) and the text decoded from them. ``words``: a lexicon (default: the frequent words of ``df``)."""
    name = _prepare(df, path, text, words)
    schema = T.StructType([T.StructField(names[0], T.ArrayType(T.IntegerType())), T.StructField(names[1], T.StringType())])

    def make():
        codec = Codec(path, Lexicon(SparkFiles.get(name)))

        def kernel(texts: pa.Array) -> list[pa.Array]:
            rows: list[list[int]] = [[] for _ in range(len(texts))]
            for i, ids, _ in codec.encode(texts.to_pylist()):
                rows[i] += map(int, ids.split())
            return [pa.array(rows, pa.list_(pa.int32())), pa.array([codec.decode(r) for r in rows], pa.string())]

        return kernel

    return with_columns(df, text, schema, make, keep=keep)


DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def encode_digests(df: DataFrame, path: str, text: str = "text", words: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``df`` with the number of tokens and the SHA-256 of the joined ids and of the decoded text."""
    name = _prepare(df, path, text, words)

    def make():
        codec = Codec(path, Lexicon(SparkFiles.get(name)))

        def kernel(texts: pa.Array) -> list[pa.Array]:
            n = [0] * len(texts)
            both = [(hashlib.sha256(), hashlib.sha256()) for _ in n]
            for i, *part in codec.encode(texts.to_pylist()):
                for digest, joined in zip(both[i], part, strict=True):
                    digest.update((b" " if n[i] else b"") + joined.encode())
                n[i] += part[0].count(" ") + 1
            return [pa.array(n, pa.int64()), *[pa.array([x[k].hexdigest() for x in both], pa.string()) for k in (0, 1)]]

        return kernel

    return with_columns(df, text, DIGEST, make, keep=keep)


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table_path(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_digests(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
