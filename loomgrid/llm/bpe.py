"""Byte-level BPE through a distinct-word table.

1. One scan cuts chunks of documents into words: each chunk sends out its distinct words by hash, and a
   head with the number of the word at each place.
2. Equal words of all chunks meet in one group, which is a part of the distinct-word table: each distinct
   word is encoded there, once.
3. The ids go back to their chunks and are joined to the places; they are decoded by a join with the
   id-to-piece table (of the size of the vocabulary).

Words are split exactly where the tokenizers library splits them: the character classes of its
pre-tokenizer are read off the library itself when the operator starts.

Defined cases: null and empty texts have no ids; the text of a special token is that token, as in
the library; repeated rows give equal rows, null ids stay null; an empty table gives an empty result;
other columns are ignored. Long texts are cut into words piece by piece; what is held of a chunk (or of the
longest text) is about 30 bytes for each of its words.
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing as pk
from . import textbatch as tb
from . import vocabulary as vc

CHUNK_BYTES = 8 << 20
#: Bytes of text that are cut into words at once.
PIECE_BYTES = 1 << 20

_LETTER, _NUMBER, _OTHER, _SPACE = 0, 1, 2, 3


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def load(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@functools.lru_cache(maxsize=2)
def character_classes(path: str) -> bytes:
    """For every code point: letter, number, other or space, as the library's splitter takes it."""
    split = load(path).pre_tokenizer.pre_tokenize_str
    out = np.full(0x110000, _OTHER, np.uint8)

    def joined(lead: str, points: list[int]) -> list[bool]:
        """Whether each character goes on with a word that ``lead`` began; a line feed parts the probes."""
        starts = {s for _, (s, _) in split("".join(f"\n{lead}{chr(c)}" for c in points))}
        return [3 * i + 2 not in starts for i in range(len(points))]

    rest = []
    for lo in (*range(0, 0x40000, 256), *range(0xE0000, 0xE0200, 256)):
        points = [c for c in range(lo, lo + 256) if not 0xD800 <= c < 0xE000]
        if all(unicodedata.category(chr(c)) in ("Cn", "Co") for c in points):
            points = points[:1]  # a block without characters is all alike
        rest += points
    for kind, lead in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!")):
        left = []
        for lo in range(0, len(rest), 4096):
            part = rest[lo : lo + 4096]
            found = joined(lead, part)
            out[[c for c, hit in zip(part, found) if hit]] = kind
            left += [c for c, hit in zip(part, found) if not hit]
        rest = left
    out[rest] = _SPACE
    return out.tobytes()


def special_tokens(path: str) -> dict[str, int]:
    return {t.content: i for i, t in load(path).get_added_tokens_decoder().items() if t.special}


def word_starts(points: np.ndarray, classes: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Mask of the code points at which a word starts.

    ``borders`` marks the points that begin a new text (or a special token, or what follows one).
    The pattern is: contractions, then an optional space with a run of letters, numbers or others,
    then white space, whose last character goes with the next word if it is a space.
    """
    n = len(points)
    kind = classes[points]
    before = np.empty(n, np.uint8)
    before[0] = 255
    before[1:] = kind[:-1]
    before[borders] = 255
    start = kind != before
    # The last white space character before a word stands alone, or leads the word if it is " ".
    word_start = start & (kind != _SPACE)
    led = word_start & (before == _SPACE)
    at = np.flatnonzero(led)
    start[at - 1] = True
    start[at[points[at - 1] == 0x20]] = False
    # Contractions: "'" that begins a word, with s, t, m, d, re, ve or ll after it in the same text.
    quotes = np.flatnonzero((points == 0x27) & start & word_start)
    quotes = quotes[quotes + 1 < n]
    quotes = quotes[~borders[quotes + 1]]
    if len(quotes):
        one = np.isin(points[quotes + 1], [ord(c) for c in "stmd"])
        third = np.where(quotes + 2 < n, points[np.minimum(quotes + 2, n - 1)], 0)
        third = np.where(borders[np.minimum(quotes + 2, n - 1)], 0, third)
        second = points[quotes + 1]
        two = ((second == ord("r")) & (third == ord("e"))) | ((second == ord("v")) & (third == ord("e")))
        two |= (second == ord("l")) & (third == ord("l"))
        for mask, size in ((one, 2), (two & ~one, 3)):
            q = quotes[mask]
            start[q + 1] = False
            after = q + size
            after = after[after < n]
            # What follows starts a word anew; white space and a space's lead have their own marks.
            start[after[kind[after] != _SPACE]] = True
    start[borders] = True
    return start


def split_texts(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, special: list[bytes]):
    """Byte starts of all words in a buffer of texts, and the number of words of each text."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    place = np.concatenate(([0], np.cumsum(width)))
    borders = np.zeros(len(points), bool)
    edges = np.searchsorted(place, offsets)
    borders[edges[edges < len(points)]] = True
    inside = np.zeros(len(points), bool)
    raw = data.tobytes() if special else b""
    for token in special:
        at = raw.find(token)
        while at >= 0:
            end = at + len(token)
            if np.searchsorted(offsets, at, side="right") == np.searchsorted(offsets, end - 1, side="right"):
                a, b = np.searchsorted(place, [at, end])
                borders[a] = True
                inside[a + 1 : b] = True
                if b < len(points):
                    borders[b] = True
                at = raw.find(token, end)
            else:
                at = raw.find(token, at + 1)
    starts = word_starts(points, classes, borders) if len(points) else np.zeros(0, bool)
    starts &= ~inside
    begin = place[:-1][starts]
    return begin, np.diff(np.searchsorted(begin, offsets))


def _cuts(data: np.ndarray, offsets: np.ndarray, limit: int):
    """Ranges of about ``limit`` bytes that begin with a text, or inside one where a word begins whatever comes before.

    Such a place is a single space between two letters or digits of ASCII.
    """
    plain = tb.table_of(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)
    lo = 0
    while lo < len(data):
        hi = lo + limit
        k = int(np.searchsorted(offsets, hi, side="right")) - 1
        if hi < len(data) and offsets[k] > lo:
            hi = int(offsets[k])  # up to the last text that begins here
        while hi < len(data) and hi not in (offsets[k], offsets[k + 1]):
            part = data[hi - 1 : min(hi + limit, int(offsets[k + 1])) + 1]
            found = np.flatnonzero((part[1:-1] == 0x20) & plain[part[:-2]] & plain[part[2:]])
            if len(found):
                hi += int(found[0])
                break
            hi = min(hi + limit, int(offsets[k + 1]))
        hi = min(hi, len(data))
        yield lo, hi
        lo = hi


def splitter(spark, tokenizer: str, piece_bytes: int = PIECE_BYTES):
    """``split`` for ``vocabulary.word_lists``."""
    table = spark.sparkContext.broadcast(character_classes(tokenizer))
    special = [t.encode() for t in special_tokens(tokenizer)]
    if any(b" " in t for t in special):
        piece_bytes = 1 << 62  # a cut could fall into such a token

    def split(data, offsets):
        classes = np.frombuffer(table.value, np.uint8)

        def pieces():
            for lo, hi in _cuts(data, offsets, piece_bytes):
                own = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, side="right")] - lo
                begin, _ = split_texts(data[lo:hi], np.unique(np.concatenate(([0], own, [hi - lo]))), classes, special)
                begin = begin + lo
                yield lo, hi, begin, np.append(begin[1:], hi)

        return data, pieces()

    return split


def encode_words(tokenizer: str, words: list[bytes], specials: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after the other, numbers of ids)."""
    tok = load(tokenizer)
    tok.encode_special_tokens = True
    ids, sizes = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
    for lo in range(0, len(words), 4096):
        part = words[lo : lo + 4096]
        made = [e.ids for e in tok.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)]
        made = [[specials[w]] if w in specials else i for w, i in zip(part, made)]
        ids.append(np.fromiter((i for own in made for i in own), "<u4"))
        sizes.append(np.array([len(i) for i in made], np.int64))
    return np.concatenate(ids), np.concatenate(sizes)


def piece_table(tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """The id-to-piece table as one buffer of bytes with offsets; its size is that of the vocabulary."""
    tok = load(tokenizer)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    added = tok.get_added_tokens_decoder()
    pieces = []
    for i in range(max(tok.get_vocab(with_added_tokens=True).values()) + 1):
        piece = added[i].content if i in added else tok.id_to_token(i)
        if piece is None:
            pieces.append(b"")
        elif i in added or any(c not in byte_of for c in piece):
            pieces.append(piece.encode())
        else:
            pieces.append(bytes(byte_of[c] for c in piece))
    return np.frombuffer(b"".join(pieces), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in pieces])))


def decode(ids: np.ndarray, pieces: np.ndarray, offsets: np.ndarray) -> bytes:
    """The text of ``ids``, by a join with the id-to-piece table; broken UTF-8 becomes U+FFFD."""
    raw = tb.join_spans(pieces, offsets[ids], offsets[ids + 1] - offsets[ids]).tobytes()
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()


def encode(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    chunk_bytes: int = CHUNK_BYTES,
    keep_ids: bool = False,
    keep_text: bool = False,
) -> DataFrame:
    """Per document: id, n_tokens, ids_sha256, decoded_sha256; with ``keep_ids`` also ids (array of
    int), with ``keep_text`` also decoded (the text that the ids give).
    """
    tokenizer = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    specials = {t.encode(): i for t, i in special_tokens(tokenizer).items()}

    def code(table: pa.Table) -> pa.Table:
        """One part of the distinct-word table: each word is encoded once, for all chunks that have it."""
        tb.tidy()
        heads, lists = vc.parted(table)
        number: dict[bytes, int] = {}
        places = [np.array([number.setdefault(w, len(number)) for w in words], np.int64) for words in vc.list_words(lists)]
        ids, sizes = encode_words(tokenizer, list(number), specials)
        first = np.cumsum(sizes) - sizes
        lists = lists.select(["chunk", "bucket", "sum"])
        lists = lists.append_column("lengths", pa.array([pk.pack(sizes[p]) for p in places], pa.binary()))
        lists = lists.append_column("ids", pa.array([pk.pack(tb.join_spans(ids, first[p], sizes[p])) for p in places], pa.binary()))
        return vc.with_heads(heads, lists)

    coded = (
        vc.word_lists(base, splitter(spark, tokenizer), buckets, chunk_bytes)
        .groupBy("bucket").applyInArrow(code, vc.head_schema(base) + ", sum long, lengths binary, ids binary")
    )
    pieces, at = piece_table(tokenizer)
    shared = spark.sparkContext.broadcast((pieces, at))

    def assemble(table: pa.Table) -> pa.Table:
        tb.tidy()
        head, lists, slot = vc.unite(table)
        sizes = np.concatenate([np.empty(0, np.int64), *(pk.unpack(x.as_py()).astype(np.int64) for x in lists.column("lengths"))])
        ids = np.concatenate([np.empty(0, "<u4"), *(pk.unpack(x.as_py(), "<u4") for x in lists.column("ids"))])
        first = np.concatenate(([0], np.cumsum(sizes)))
        place = slot.astype(np.int32)[pk.unpack_skewed(head.column("stream")[0].as_py())]
        bounds = np.concatenate(([0], np.cumsum(pk.unpack(head.column("sizes")[0].as_py()).astype(np.int64))))
        pieces, at = shared.value
        doc_ids = head.column("docs").combine_chunks()[0].values
        rows, kept, texts = [], [], []
        for a, b in zip(bounds, bounds[1:]):
            own = tb.join_spans(ids, first[place[a:b]], sizes[place[a:b]])
            text = decode(own.astype(np.int64), pieces, at)
            rows.append((len(own), hashlib.sha256(own.tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()))
            if keep_ids:
                kept.append(own.view("<i4"))
            if keep_text:
                texts.append(text.decode())
        n, a, b = zip(*rows)
        out = {"doc_id": doc_ids, "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a), "decoded_sha256": pa.array(b)}
        if keep_ids:
            ends = np.cumsum([0, *n])
            out["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(kept)))
        if keep_text:
            out["decoded"] = pa.array(texts, pa.string())
        return pa.table(out)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    return coded.groupBy("chunk").applyInArrow(assemble, schema)
