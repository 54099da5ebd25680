"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

Text runs through NFC, white space and case mapping, is split into pieces by
the vocabulary's pattern, and each piece is encoded as UTF-8 bytes, the last
one carrying the word-end mark.

Lookahead. Let two inputs share a prefix and apply the merges in rank order.
The place where their symbols begin to differ moves left only when a merge
(u, v) joins the last equal symbol u with what follows in one input and not in
the other, and then by len(u); the v of a later such merge starts with the
text of the earlier u. So the longest chain of merges of rising rank, each
one's right part starting with the text of the one before's left part, weighed
by the lengths of the left parts, bounds how far the end of the input can
reach back: tokens that end ``lookahead`` bytes before the end of what was read
are stable. ``sufficient_lookahead`` computes this bound from the merge list;
it needs merges that only use parts made by earlier merges, which is checked.
A piece is fed in steps of STEP bytes to a ``Run``: stable tokens are emitted,
the rest (at most STEP + lookahead + one token) stays. A cut at a token edge
leaves both sides to merge by themselves, so the tokens equal those of the
whole piece. A bounded table remembers the tokens of short pieces.

Text comes to an ``Encoder`` in blocks of any size, and ids leave as soon as
they are settled. A block is taken up to its last white space or, in text
without any, to a character that neither joins the one before in NFC nor
stands inside a special token; the last piece before such a cut is held until
its end is known, and once it is long it goes on as an open Run. So memory is
constant but for one thing: a run of combining marks, whose canonical order is
only known at its end, is held whole.

Decoding is by state machines over ids: ``Plain`` gives the tokens' text joined
by single spaces (what the vocabulary without a decoder defines), ``Text``
turns the byte alphabet back to bytes and those to text incrementally, word
ends to spaces. Digests take ids and texts block by block.

Defined results: null and empty texts have no ids and decode to the empty
text. Special tokens in a text are recognised as such, as the library does by
default. Lone surrogates are replaced by U+FFFD.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_batches, texts_of

WORD_END = "</w>"
#: Bytes of a piece between two looks for stable tokens; characters of a block of text; characters of a held piece that becomes a run.
STEP, BLOCK, LONG = 4096, 1 << 16, 1 << 12
#: Pieces up to so many characters are remembered, and so many of them.
REMEMBER_CHARS, REMEMBER = 48, 400_000
#: White space by the Unicode property, as the vocabulary's \s means it.
SPACE = r"[\t-\r \x85\xA0  -     　]"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Bytes of further input that settle a token; see the module's text."""
    made_at = {}
    for rank, (a, b) in enumerate(merges):
        made_at.setdefault(a + b, rank)
    reach: dict[str, int] = {}  # text of a left part: heaviest chain that ends with such a merge
    most = 0
    for rank, (a, b) in enumerate(merges):
        if made_at.get(a, -1) >= rank or made_at.get(b, -1) >= rank:
            raise ValueError("the merge list uses a part before it is made")
        right = b.removesuffix(WORD_END)
        before = max((reach.get(right[:k], 0) for k in range(1, len(right) + 1)), default=0)
        left = len(a.removesuffix(WORD_END))
        reach[a] = max(reach.get(a, 0), before + left)
        most = max(most, reach[a])
    longest = max((len(a) + len(b.removesuffix(WORD_END)) for a, b in merges), default=1)
    return most + longest


class Transducer:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != WORD_END:
            raise ValueError("a BPE vocabulary with word ends is needed")
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.lookahead = sufficient_lookahead(merges)
        self.pairs = {}
        for rank, (a, b) in enumerate(merges):
            self.pairs.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]
        self.decimal = [str(i) for i in range(len(self.names))]
        alphabet = byte_alphabet()
        self.inner = [self.vocab[alphabet[b]] for b in range(256)]
        self.final = [self.vocab[alphabet[b] + WORD_END] for b in range(256)]
        self.bytes_of = {c: b for b, c in alphabet.items()}
        self.width = [len(t.removesuffix(WORD_END)) for t in self.names]
        self.find_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special))) + ")")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        other = rf"[^\p{{L}}\p{{N}}{SPACE[1:-1]}]"
        self.pieces = regex.compile(split.replace(r"[^\s\p{L}\p{N}]", other))
        self.find_pieces = self.pieces.findall
        self.runs = regex.compile(r"\p{L}+"), regex.compile(other + "+")
        self.raw = [b"" if t in self.special else bytes(self.bytes_of[c] for c in t.removesuffix(WORD_END)) + b" " * t.endswith(WORD_END) for t in self.names]
        self.special_ids = frozenset(self.special.values())
        self.known: dict[str, list[int]] = {}

    # encoding

    def normal(self, text: str) -> str:
        """NFC, then one-to-one case mapping (no look at a sigma's place); white space only parts pieces."""
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply merges, lowest rank first and leftmost among equals."""
        n = len(symbols)
        if n < 2:
            return symbols
        pairs = self.pairs
        if n <= 24:
            while len(symbols) > 1:
                best, at = None, -1
                for i in range(len(symbols) - 1):
                    found = pairs.get((symbols[i], symbols[i + 1]))
                    if found is not None and (best is None or found[0] < best[0]):
                        best, at = found, i
                if best is None:
                    break
                symbols[at : at + 2] = [best[1]]
            return symbols
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(p[0], i, p[1], symbols[i], symbols[i + 1]) for i in range(n - 1) if (p := pairs.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], symbols[j], k = made, -1, after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
                if p := pairs.get((made, symbols[k])):
                    heapq.heappush(heap, (p[0], i, p[1], made, symbols[k]))
            if (h := before[i]) >= 0 and (p := pairs.get((symbols[h], made))):
                heapq.heappush(heap, (p[0], h, p[1], symbols[h], made))
        out, i = [], 0
        while i >= 0:
            out.append(symbols[i])
            i = after[i]
        return out

    def stream(self, blocks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one piece that comes in blocks of bytes, each id as soon as it is stable."""
        run = Run(self)
        for block in blocks:
            yield from run.feed(block)
        yield from run.close()

    def encode_piece(self, piece: str) -> list[int]:
        run = Run(self)
        ids = run.feed(piece.encode("utf-8")) + run.close()
        if len(piece) <= REMEMBER_CHARS:
            if len(self.known) >= REMEMBER:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode_blocks(self, text: str | None) -> Iterator[list[int]]:
        """Ids of a text, block by block."""
        text, encoder = text or "", Encoder(self)
        for i in range(0, len(text) - BLOCK, BLOCK):
            yield encoder.feed(text[i : i + BLOCK])
        yield encoder.feed(text[max(0, (len(text) - 1) // BLOCK * BLOCK) :]) + encoder.close() if len(text) > BLOCK else encoder.close(text)

    def encode(self, text: str | None) -> list[int]:
        return [i for block in self.encode_blocks(text) for i in block]

    # decoding

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """``plain`` text of ids, a part for each."""
        state = Plain(self)
        for i in ids:
            yield state.feed((i,))

    def decode(self, ids: Iterable[int]) -> str:
        return Plain(self).feed(ids)

    def text_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of ids: bytes that do not yet make a character are held, wrong ones become U+FFFD."""
        state = Text(self)
        for i in ids:
            yield state.feed((i,))
        yield state.close()


class Run:
    """The transducer's state inside one piece: bytes whose tokens are not stable yet."""

    def __init__(self, t: Transducer) -> None:
        self.t, self.pending, self.last = t, [], None

    def feed(self, raw: bytes) -> list[int]:
        """Tokens that more bytes can't change any more."""
        out: list[int] = []
        t, inner = self.t, self.t.inner
        for i in range(0, len(raw), STEP):
            step = raw[i : i + STEP]
            if self.last is not None:
                self.pending.append(inner[self.last])
            self.pending += [inner[b] for b in step[:-1]]
            self.last = step[-1]
            stable = len(self.pending) - t.lookahead
            if stable <= 0:
                continue
            merged = t.merge(list(self.pending))
            end = k = 0
            while k < len(merged) and end + t.width[merged[k]] <= stable:
                end += t.width[merged[k]]
                k += 1
            out += merged[:k]
            del self.pending[:end]
        return out

    def close(self) -> list[int]:
        """The rest, now that the last byte is known."""
        out = self.t.merge([*self.pending, self.t.final[self.last]]) if self.last is not None else []
        self.pending, self.last = [], None
        return out


@lru_cache(maxsize=1)
def joiners() -> frozenset[str]:
    """Characters that NFC may join to the one before."""
    found = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for c in range(sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(c))
        if parts and not parts.startswith("<") and " " in parts:
            found.add(chr(int(parts.split()[1], 16)))
    return frozenset(found)


class Encoder:
    """Text in blocks to ids: ``feed`` gives what is settled, ``close`` the rest."""

    def __init__(self, t: Transducer) -> None:
        self.t = t
        self.raw = ""  # text behind the last cut
        self.held = ""  # normalised text from the start of a piece whose end is not known
        self.run: Run | None = None  # the transducer inside a long piece
        self.kind: regex.Pattern | None = None
        self.reach = max(map(len, t.special))

    @property
    def size(self) -> int:
        """Characters and symbols that are held."""
        return len(self.raw) + len(self.held) + (len(self.run.pending) if self.run else 0)

    def feed(self, block: str) -> list[int]:
        self.raw += block
        at = max(self.raw.rfind(" "), self.raw.rfind("\n"))
        white = at > 0
        if not white and len(self.raw) >= BLOCK:
            at = self._cut()
        if at <= 0:
            return []
        part, self.raw = self.raw[:at], self.raw[at:]
        return self._take(part, not white)

    def close(self, rest: str = "") -> list[int]:
        part, self.raw = self.raw + rest, ""
        return self._take(part, False)

    def _cut(self) -> int:
        """A place where NFC and special tokens can be cut; 0 where there is none."""
        raw, at = self.raw, len(self.raw) - self.reach
        while at > 0 and not (raw[at] < "\x80" or not unicodedata.combining(raw[at]) and raw[at] not in joiners()):
            at -= 1
        for name in self.t.special:
            start = raw.find(name, max(0, at - len(name) + 1), at + len(name) - 1)
            if 0 <= start < at:
                return start or len(name)
        return at

    def _take(self, text: str, open_: bool) -> list[int]:
        t, out = self.t, []
        if not text.isascii():
            text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        parts = t.find_special.split(text) if "<|" in text else (text,)
        for k, part in enumerate(parts):
            if part in t.special:
                out.append(t.special[part])
            else:
                out += self._pieces(t.normal(part), open_ and k == len(parts) - 1)
        return out

    def _pieces(self, text: str, open_: bool) -> list[int]:
        t, out = self.t, []
        if self.run is not None:
            more = self.kind.match(text)
            end = more.end() if more else 0
            out += self.run.feed(text[:end].encode())
            if open_ and end == len(text):
                return out
            out += self.run.close()
            self.run, text = None, text[end:]
        text, self.held = self.held + text, ""
        if open_:
            starts = [m.start() for m in t.pieces.finditer(text)]
            back = starts[-1] if starts else len(text)
            if len(starts) > 1 and text[starts[-2] : back] == "'" and len(text) - back <= 2:
                back = starts[-2]  # with the next letters it may be one piece
            text, self.held = text[:back], text[back:]
        known, encode_piece = t.known.get, t.encode_piece
        for piece in t.find_pieces(text):
            out += known(piece) or encode_piece(piece)
        if len(self.held) >= LONG:
            self.kind = next(r for r in t.runs if r.match(self.held))
            self.run = Run(t)
            out += self.run.feed(self.held.encode())
            self.held = ""
        return out


class Plain:
    """Token names joined by single spaces; the state is whether one came before."""

    def __init__(self, t: Transducer) -> None:
        self.names, self.between = t.names, ""

    def feed(self, ids: Iterable[int]) -> str:
        found = " ".join(map(self.names.__getitem__, ids))
        if found:
            found, self.between = self.between + found, " "
        return found


class Text:
    """Bytes of tokens to text; the state is the bytes of a character that is not whole."""

    def __init__(self, t: Transducer) -> None:
        self.t, self.state = t, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        t, ids = self.t, list(ids)
        if t.special_ids.isdisjoint(ids):
            return self.state.decode(b"".join(map(t.raw.__getitem__, ids)))
        out = []
        for i in ids:
            out.append(self.close() + t.names[i] if i in t.special_ids else self.state.decode(t.raw[i]))
        return "".join(out)

    def close(self) -> str:
        found = self.state.decode(b"", True)
        self.state.reset()
        return found


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    """One for each worker process and file."""
    return Transducer(path)


def encode_texts(df: DataFrame, path: str, column: str = "text") -> DataFrame:
    """df's key column doc_id with ids (array of int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            ids = pa.array([t.encode(x) for x in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return map_batches(df.select("doc_id", column), run, "doc_id long, ids array<int>")


def decode_ids(df: DataFrame, path: str, plain: bool = True) -> DataFrame:
    """doc_id and text of the column ids (null: no ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            texts = [t.decode(x or ()) if plain else "".join(t.text_stream(x or ())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(df.select("doc_id", "ids"), run, "doc_id long, text string")


def digests(t: Transducer, text: str) -> tuple[int, str, str, str]:
    """Number of ids, and SHA-256 of ids, plain text and text; block by block."""
    n, between = 0, ""
    of_ids, of_plain, of_text = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
    plain, back = Plain(t), Text(t)
    for ids in t.encode_blocks(text):
        if ids:
            n += len(ids)
            of_ids.update((between + " ".join(map(t.decimal.__getitem__, ids))).encode())
            of_plain.update(plain.feed(ids).encode())
            of_text.update(back.feed(ids).encode())
            between = " "
    of_text.update(back.close().encode())
    return n, of_ids.hexdigest(), of_plain.hexdigest(), of_text.hexdigest()


ROUND_TRIP = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, text_sha256 string"


def round_trip_digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and text_sha256 (of the byte decoder's text) of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            rows = [digests(t, text) for text in texts_of(batch.column(1))]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            found = [pa.array(c, pa.string() if k else pa.int64()) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found], [x.split()[0] for x in ROUND_TRIP.split(", ")])

    return map_batches(df.select("doc_id", "text"), run, ROUND_TRIP)


def op5_bpe_transducer(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every whole text encoded and decoded again."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return round_trip_digests(documents(spark, sf_dir), vocabulary)
