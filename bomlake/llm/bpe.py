"""BPE encoding and decoding as streaming transducers.

Encoding reads a text in blocks and emits a token once no further input can change it. From the merge
list follows a sufficient lookahead: the farthest that unknown input to the right can reach to the left.
Tokens that end earlier than that are final, and by the substring property of BPE the rest is encoded on
from there, so memory stays constant however long a word or text is.

Decoding is a state machine from ids to text: token texts joined by a space where the vocabulary file
has no decoder, and for byte-level decoders a UTF-8 machine that holds back an incomplete character.

Defined results: a null text is an empty one; an empty text has no tokens and decodes to ''; rows with
equal or null ids are encoded one by one; other columns of the input don't matter.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare, worker_state

#: Fixed values of the file format: white space as its patterns mean it, the pieces of its split pattern.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters of a text that are read at a time, and that a run without a white space may have to be kept whole.
BLOCK, WHOLE = 1 << 16, 512
#: Words, and pieces of words, whose ids a worker remembers.
REMEMBERED = 300_000
NO_RANK = 1 << 30


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], width) -> int:
    """Symbols to the right after which a token is final.

    Two inputs that agree up to a place p can differ to the left of p only through a chain of merges of
    rising rank, each of which ends where the last difference starts or shares its start. reach[t] is the
    farthest to the left of p at which a token t in question can start.
    """
    reach: dict[str, int] = {}
    for left, right in merges:
        far = max(width(left) + width(right), reach.get(left, 0), width(left) + reach.get(right, 0))
        for token in (left, left + right):
            reach[token] = max(far, reach.get(token, 0))
    return max(reach.values(), default=1)


def composing() -> frozenset[str]:
    """Characters that can join a preceding one under NFC."""
    seconds = {chr(int(d.split()[1], 16)) for c in range(0x110000) if (d := unicodedata.decomposition(chr(c))) and d[0] != "<" and " " in d}
    return frozenset(seconds | {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]})


#: Neither letter, number nor white space.
STAND_IN = "\ue000"


def newer_characters() -> frozenset[str]:
    """Letters and numbers of this Python's Unicode version that the tokenizers library, whose version is older, doesn't know as such."""
    import regex
    from tokenizers import Regex, pre_tokenizers

    every = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    out: list[str] = []
    for kind in (r"\p{L}", r"\p{N}"):
        own, rest = "".join(regex.findall(kind, every)), pre_tokenizers.Split(Regex(f"{kind}+"), "removed")
        for i in range(0, len(own), 1024):
            out += [x for x, _ in rest.pre_tokenize_str(own[i : i + 1024])]
    return frozenset("".join(out))


def normalizer():
    from tokenizers import normalizers

    return worker_state("bpe", "normalizer", lambda: normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]))


class Vocabulary:
    """A tokenizer file: ids, merge ranks and the lookahead that follows from them."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.end = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.texts = {i: t for t, i in [*self.ids.items(), *self.specials.items()]}
        self.byte_level = (file.get("decoder") or {}).get("type") == "ByteLevel"
        self.letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        end = len(self.end)
        self.width = lambda token: len(token) - end if end and token.endswith(self.end) else len(token)
        self.lookahead = sufficient_lookahead(merges, self.width)
        self.special = regex.compile("|".join(map(regex.escape, self.specials)) or r"(?!)")
        self.longest_special = max(map(len, self.specials), default=1)
        self.pieces = regex.compile(PIECES.replace(r"\s", SPACES))
        self.spaces = regex.compile(f"[{SPACES}]+")
        self.letter_run = regex.compile(r"\p{L}*")
        self.other_run = regex.compile(PIECES.rsplit("|", 1)[1].replace(r"\s", SPACES)[:-1] + "*")
        self.newer = newer_characters()
        self.stand_ins = dict.fromkeys(map(ord, self.newer), STAND_IN)
        self.composing: frozenset[str] | None = None
        self.known: dict[str, bytes] = {}
        self.pieced: dict[str, list[int]] = {}

    def joins_previous(self, c: str) -> bool:
        if self.composing is None:
            self.composing = composing()
        return unicodedata.category(c) in ("Mn", "Mc", "Cn") or unicodedata.combining(c) > 0 or c in self.composing

    def normal(self, text: str) -> str:
        """NFC and lower case, each character for itself, by the tokenizers library's own tables where these matter."""
        return text.lower() if text.isascii() else normalizer().normalize_str(text)

    def classed(self, text: str) -> str:
        """The text with a stand-in for each character that is no letter or number to the tokenizers library."""
        return text if text.isascii() or self.newer.isdisjoint(text) else text.translate(self.stand_ins)

    def split(self, text: str) -> list[str]:
        classed = self.classed(text)
        return self.pieces.findall(text) if classed is text else [text[m.start() : m.end()] for m in self.pieces.finditer(classed)]

    def symbols(self, piece: str) -> list[str]:
        letters = self.letters
        return [letters[b] for b in piece.encode()]

    def merge(self, symbols: list[str]) -> list[str]:
        """Applies the merge list to symbols, the lowest rank first and the leftmost of equals."""
        n, rank = len(symbols), self.rank
        if n < 64:
            ranks = [rank.get(p, NO_RANK) for p in zip(symbols, symbols[1:])]
            while ranks and (least := min(ranks)) < NO_RANK:
                i = ranks.index(least)
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
                del ranks[i]
                if i:
                    ranks[i - 1] = rank.get((symbols[i - 1], symbols[i]), NO_RANK)
                if i < len(ranks):
                    ranks[i] = rank.get((symbols[i], symbols[i + 1]), NO_RANK)
            return symbols
        token, after, before = list(symbols), [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(rank[p], i, p) for i in range(n - 1) if (p := (token[i], token[i + 1])) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if token[i] else -1
            if j < 0 or (token[i], token[j]) != pair:
                continue
            token[i], token[j], after[i] = token[i] + token[j], "", after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else -1
                if b >= 0 and (p := (token[a], token[b])) in rank:
                    heapq.heappush(heap, (rank[p], a, p))
        return [t for t in token if t]


class WordTransducer:
    """Symbols of one word, fed in parts -> ids; holds at most the lookahead and one block."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.held = vocabulary, []

    def feed(self, symbols: list[str]) -> list[int]:
        v, out = self.v, []
        self.held += symbols
        if len(self.held) > 2 * v.lookahead + 1024:
            # the last symbol stays back: at a word's end it would be another one
            tokens, final, used = v.merge(self.held[:-1]), len(self.held) - 1 - v.lookahead, 0
            for token in tokens:
                if used + v.width(token) > final:
                    break
                used += v.width(token)
                out.append(v.ids[token])
            del self.held[:used]
        return out

    def finish(self) -> list[int]:
        held, self.held = self.held, []
        if held:
            held[-1] += self.v.end
        return [self.v.ids[t] for t in self.v.merge(held)]


class Encoder:
    """Text in parts -> ids as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.raw = ""  # not yet cut at a white space
        self.word = WordTransducer(vocabulary)
        self.open = ""  # kind of the piece that goes on beyond a part: L, O or none
        self.rest = ""  # normal text that may belong to the next piece

    def feed(self, text: str) -> bytes:
        text = self.raw + text
        cut = max((m.end() for m in self.v.spaces.finditer(text, max(0, len(text) - WHOLE))), default=0)
        if not cut and len(text) <= WHOLE:
            self.raw = text
            return b""
        if not cut:
            cut = max((m.end() for m in self.v.spaces.finditer(text)), default=0)
        self.raw = text[cut:]
        out = self._whole(text[:cut]) if cut else b""
        while len(self.raw) > 8 * WHOLE:  # a long run without white space
            out += self._long()
        return out

    def finish(self) -> bytes:
        raw, self.raw = self.raw, ""
        return (self._part(raw, True) if self.open or self.rest or len(raw) > WHOLE else self._whole(raw)) if raw or self.open or self.rest else b""

    def _whole(self, text: str) -> bytes:
        """A text that ends at a white space or at the end."""
        out = b""
        if self.open or self.rest:
            m = self.v.spaces.search(text)
            out, text = self._part(text[: m.start()], True), text[m.start() :]
        known = self.v.known
        # str.split() takes U+001C to U+001F for white space too
        plain = not any(c in text for c in "\x1c\x1d\x1e\x1f")
        words = text.split() if plain else filter(None, self.v.spaces.split(text))
        return out + b"".join([known[w] if w in known else self._chunk(w) for w in words])

    def _chunk(self, chunk: str) -> bytes:
        """A run without white space."""
        if len(chunk) > WHOLE:
            out = b"".join(self._part(chunk[i:j], j >= len(chunk)) for i, j in self._cuts(chunk))
        else:
            v, ids, at = self.v, [], 0
            for m in [*v.special.finditer(chunk), None]:
                for piece in v.split(v.normal(chunk[at : m.start() if m else len(chunk)])):
                    ids += v.pieced[piece] if piece in v.pieced else self._piece(piece)
                if m:
                    ids.append(v.specials[m.group()])
                    at = m.end()
            out = packed(ids)
        if len(chunk) <= 64:
            if len(self.v.known) >= REMEMBERED:
                self.v.known.clear()
            self.v.known[chunk] = out
        return out

    def _piece(self, piece: str) -> list[int]:
        v = self.v
        symbols = v.symbols(piece)
        symbols[-1] += v.end
        if len(v.pieced) >= REMEMBERED:
            v.pieced.clear()
        v.pieced[piece] = ids = [v.ids[t] for t in v.merge(symbols)]
        return ids

    def _cuts(self, chunk: str):
        at = 0
        while at < len(chunk):
            to = self._safe(chunk, min(len(chunk), at + 4 * WHOLE))
            yield at, to
            at = to

    def _safe(self, text: str, at: int) -> int:
        """The next place from `at` on before which nothing joins under NFC and no special token is open."""
        while at < len(text) and (self.v.joins_previous(text[at]) or self._splits_special(text, at)):
            at += 1
        return at

    def _splits_special(self, text: str, at: int) -> bool:
        n = self.v.longest_special
        return any(text.startswith(s, i) for i in range(max(0, at - n + 1), at) for s in self.v.specials if i + len(s) > at)

    def _long(self) -> bytes:
        n = self.v.longest_special
        to = self._safe(self.raw, 4 * WHOLE)
        if to > len(self.raw) - n:
            to = len(self.raw)
            out, self.raw = self._part(self.raw[:to], False), ""
            return out
        part, self.raw = self.raw[:to], self.raw[to:]
        return self._part(part, False)

    def _part(self, part: str, last: bool) -> bytes:
        """A part of a long run without white space, cut at a safe place."""
        v, out, at = self.v, [], 0
        for m in [*v.special.finditer(part), None]:
            text = self.rest + v.normal(part[at : m.start() if m else len(part)])
            out += self._pieces(text, last or m is not None)
            if m:
                out.append(v.specials[m.group()])
                at = m.end()
        return packed(out)

    def _pieces(self, text: str, closed: bool) -> list[int]:
        v, out, at = self.v, [], 0
        self.rest = ""
        classed = v.classed(text)
        if self.open:
            at = (v.letter_run if self.open == "L" else v.other_run).match(classed).end()
            out += self.word.feed(v.symbols(text[:at]))
            if at < len(text) or closed:
                out += self.word.finish()
                self.open = ""
        if self.open:
            return out
        stop = len(text) if closed else len(text) - 3  # a contraction has three characters at most
        for m in v.pieces.finditer(classed, at):
            if m.start() >= stop:
                break
            at = m.end()
            out += self.word.feed(v.symbols(text[m.start() : at]))
            if at == len(text) and not closed:  # numbers and contractions are whole, runs may go on
                self.open = "L" if v.letter_run.fullmatch(m.group()) else "O" if v.other_run.fullmatch(m.group()) else ""
            if not self.open:
                out += self.word.finish()
        self.rest = "" if closed else text[at:]
        return out


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Decoder:
    """Ids in parts -> text."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.first = vocabulary, True
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        tokens = [self.v.texts[i] for i in np.frombuffer(ids, "<u4").tolist()]
        if not tokens:
            return ""
        if self.v.byte_level:
            byte_of = self.v.byte_of
            return self.utf8.decode(b"".join(t.encode() if t in self.v.specials else bytes(map(byte_of.__getitem__, t)) for t in tokens))
        text = " ".join(tokens)
        text, self.first = text if self.first else " " + text, False
        return text

    def finish(self) -> str:
        return self.utf8.decode(b"", True)


def vocabulary(path: str) -> Vocabulary:
    return worker_state("bpe", f"bpe:{path}", lambda: Vocabulary(path))


def encode(text: str | None, v: Vocabulary, block: int = BLOCK):
    """Yields the ids of a text, packed, block by block."""
    encoder, text = Encoder(v), text or ""
    for i in range(0, len(text), block):
        yield encoder.feed(text[i : i + block])
    yield encoder.finish()


def digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encodes and decodes every text: key, n_tokens, ids_sha256, decoded_sha256. Nothing is shuffled."""
    prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def work(batches):
        v = vocabulary(path)
        for batch in batches:
            counts, ids_hex, text_hex = [], [], []
            for value in batch.column(1):
                decoder, ids, decoded, n = Decoder(v), hashlib.sha256(), hashlib.sha256(), 0
                for part in encode(value.as_py(), v):
                    n += len(part) // 4
                    ids.update(part)
                    decoded.update(decoder.feed(part).encode())
                decoded.update(decoder.finish().encode())
                counts.append(n)
                ids_hex.append(ids.hexdigest())
                text_hex.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[key], docs[text].cast("string")).mapInArrow(work, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
