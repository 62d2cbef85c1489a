"""Media columns: baseline JPEG, read as thumbnails made of the blocks' mean brightness."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, texts

#: Samples in a row of blocks, the unit to which a payload is filled up with bytes 32; rows in one image.
ROW, ROWS = 192, 8191
# Fixed values of the JPEG standard: code lengths of the luminance DC table, and the order of coefficients is not needed here.
DC_COUNTS, DC_SYMBOLS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))
#: The only AC symbol of a flat block is the end of the block.
AC_COUNTS, AC_SYMBOLS = bytes([1] + [0] * 15), bytes([0])
_TEXT_BYTES = 2 << 20


def code_table(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Length and symbol of the code that any 16 bits begin with; length 0 where none does."""
    length, symbol = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    code, k = 0, 0
    for bits in range(1, 17):
        for _ in range(counts[bits - 1]):
            at = code << (16 - bits)
            length[at : at + (1 << (16 - bits))], symbol[at : at + (1 << (16 - bits))] = bits, symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return length, symbol


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for a flat block, by its difference of -255 to 255 from the block before."""
    bits, number = np.zeros(511, np.int64), np.zeros(511, np.int64)
    codes, code, k = {}, 0, 0
    for n in range(1, 17):
        for _ in range(DC_COUNTS[n - 1]):
            codes[DC_SYMBOLS[k]] = (code, n)
            code, k = code + 1, k + 1
        code <<= 1
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = codes[size]
        own = d if d >= 0 else d + (1 << size) - 1
        bits[d + 255], number[d + 255] = ((code << size) | own) << 1, n + size + 1
    return bits, number


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    return b"\xff\xd8" + b"".join([
        _segment(0xDB, b"\0" + bytes([8] * 64)),
        _segment(0xC0, struct.pack(">BHHB", 8, 8 * rows, 8 * ROW, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, b"\x00" + DC_COUNTS + DC_SYMBOLS),
        _segment(0xC4, b"\x10" + AC_COUNTS + AC_SYMBOLS),
        _segment(0xDD, struct.pack(">H", ROW)),
        _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ])


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """Each payload, a positive multiple of 192 bytes, as baseline JPEG images of flat 8 x 8 blocks, one block a byte.

    A block's DC coefficient is the byte less 128 at a quantiser of 8, which is exact: its samples all equal the byte.
    A row of 192 blocks is a restart interval. Payloads of over 8191 rows become several images in turn.
    """
    bits, number = _block_codes()
    heights = [[min(ROWS, r - i) for i in range(0, r, ROWS)] for r in (len(p) // ROW for p in payloads)]
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW).astype(np.int16)
    if not len(rows):
        return []
    steps = np.diff(rows, axis=1, prepend=np.int16(128)) + 255
    sizes, codes = number[steps], bits[steps]
    ends = np.cumsum(sizes, axis=1)
    row_bytes = (ends[:, -1] + 7) >> 3
    base = np.concatenate([[0], np.cumsum(row_bytes)])
    at = ((ends - sizes) + 8 * base[:-1, None]).ravel()
    word = codes.ravel() << (24 - sizes.ravel() - (at & 7))
    at >>= 3
    out = sum(np.bincount(at + k, (word >> (16 - 8 * k)) & 255, base[-1] + 3) for k in range(3))[: base[-1]].astype(np.uint8)
    out[base[1:] - 1] |= ((1 << (8 * row_bytes - ends[:, -1])) - 1).astype(np.uint8)
    # Room for a zero after each 255 and for the marker after each row.
    full = out == 255
    moved = np.arange(len(out)) + np.concatenate([[0], np.cumsum(full)[:-1]]) + 2 * np.repeat(np.arange(len(rows)), row_bytes)
    done = np.zeros(len(out) + int(full.sum()) + 2 * len(rows), np.uint8)
    done[moved] = out
    stop = moved[base[1:] - 1] + 1 + full[base[1:] - 1]
    flat = [h for hs in heights for h in hs]
    within = np.concatenate([np.arange(h) for h in flat])
    done[stop], done[stop + 1] = 255, 0xD0 + within % 8
    last = np.cumsum(flat) - 1
    done[stop[last] + 1] = 0xD9
    cuts, whole, images = np.concatenate([[0], stop[last] + 2]), done.tobytes(), []
    images = [_header(h) + whole[a:b] for h, a, b in zip(flat, cuts, cuts[1:])]
    joined, k = [], 0
    for hs in heights:
        joined.append(b"".join(images[k : k + len(hs)]))
        k += len(hs)
    return joined


class Image:
    """What the markers of one baseline image say, and where its scan lies."""

    def __init__(self) -> None:
        self.width = self.height = self.interval = 0
        self.quant: dict[int, int] = {}
        self.tables: dict[int, bytes] = {}
        self.parts: list[tuple[int, int, int, int]] = []  # id, horizontal and vertical sampling, quantiser
        self.scan: list[tuple[int, int, int]] = []  # id, DC and AC table
        self.data = b""


def parse(data: bytes) -> list[Image]:
    """The images that follow each other in data; bytes after them that begin no image are passed over.

    Raises ValueError for what is not baseline JPEG, and for images of several scans: all components have to be in one.
    """
    images, at = [], 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            if images:
                break
            raise ValueError("no image begins here")
        image, at = Image(), at + 2
        while True:
            if at + 4 > len(data) or data[at] != 0xFF:
                raise ValueError("a marker is missing")
            marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if marker == 0xFF:
                at += 1
                continue
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    image.quant[body[0] & 15] = body[1] << 8 | body[2] if wide else body[1]
                    body = body[1 + 64 * (1 + wide) :]
            elif marker in (0xC0, 0xC1):
                bits, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
                if bits != 8 or len(body) < 6 + 3 * n:
                    raise ValueError("not 8 bits a sample")
                image.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not baseline")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    image.tables[body[0]] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif marker == 0xDD:
                image.interval = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                image.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                break
        end = at
        while True:
            end = data.find(b"\xff", end)
            if end < 0 or end + 1 >= len(data):
                raise ValueError("the scan has no end")
            if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                jump = data.find(b"\xff\xd9", end)  # most scans hold many stuffed bytes and one end
                if jump < 0:
                    raise ValueError("the scan has no end")
                end = jump
                continue
            break
        if data[end + 1] != 0xD9 or {c for c, *_ in image.scan} != {c for c, *_ in image.parts}:
            raise ValueError("not one scan of all components")
        image.data, at = data[at:end], end + 2
        images.append(image)
    if not images:
        raise ValueError("no image")
    return images


def _lanes(scans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All scans without stuffing and restart markers; where each restart interval begins, and which scan it is of."""
    data = np.frombuffer(b"".join(scans) + b"\0", np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in scans])])
    full = np.flatnonzero(data[:-1] == 255)
    after = data[full + 1]
    restart = full[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(data) - 1, bool)
    keep[full[after == 0] + 1] = False
    keep[restart], keep[restart + 1] = False, False
    new = np.concatenate([[0], np.cumsum(keep)])
    begin = np.sort(np.concatenate([starts[:-1], restart + 2]))
    return data[:-1][keep], new[begin], np.searchsorted(starts, begin, "right") - 1


def _decode_alike(images: list[Image]) -> list[np.ndarray]:
    """The thumbnails of images that share their tables and layout: all restart intervals advance block by block together."""
    first = images[0]
    parts = {c: (h, v, q) for c, h, v, q in first.parts}
    tables = {k: code_table(t[:16], t[16:].ljust(256, b"\0")) for k, t in first.tables.items()}
    hmax, vmax = max(p[1] for p in first.parts), max(p[2] for p in first.parts)
    alone = len(first.scan) == 1
    blocks = [(c, dc, ac, i) for c, dc, ac in first.scan for i in range(1 if alone else parts[c][0] * parts[c][1])]
    size = [(-(-im.width // 8), -(-im.height // 8)) if alone else (-(-im.width // (8 * hmax)), -(-im.height // (8 * vmax))) for im in images]
    data, begin, owner = _lanes([im.data for im in images])
    data = np.concatenate([data, np.full(8, 255, np.uint8)]).astype(np.int64)
    window = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    limit = 8 * (len(window) - 4)
    units = np.array([w * h for w, h in size])[owner]
    nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
    every = np.array([im.interval or 1 << 40 for im in images])[owner]
    units = np.clip(units - nth * every, 0, every)
    order = np.argsort(-units, kind="stable")
    begin, units = begin[order], units[order]
    bit, before = 8 * begin.astype(np.int64), {c: np.zeros(len(begin), np.int64) for c, *_ in first.scan}
    luma = first.parts[0][0]
    per = sum(c == luma for c, *_ in blocks)
    out = np.zeros((len(begin), int(units.max(initial=0)) * per), np.int16)
    alive, used = np.searchsorted(-units, -np.arange(out.shape[1] // max(per, 1)), "left"), 0

    def take(p: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        top = (window[p >> 3] >> (8 - (p & 7))) & 0xFFFF
        return p + table[0][top], table[1][top].astype(np.int64)

    for n in alive:
        if n == 0:
            break
        for c, dc, ac, _ in blocks:
            p, s = take(np.minimum(bit[:n], limit), tables[dc])
            extra = (window[np.minimum(p, limit) >> 3] >> (24 - (p & 7) - s)) & ((1 << s) - 1)
            before[c][:n] += np.where(extra < (1 << s) >> 1, extra - (1 << s) + 1, extra)
            if c == luma:
                out[:n, used] = before[c][:n]
                used += 1
            p = np.minimum(p + s, limit)
            p, rs = take(p, tables[16 + ac])
            todo = np.flatnonzero(rs)
            k = np.ones(len(todo), np.int64)
            while len(todo):
                r, s = rs[todo] >> 4, rs[todo] & 15
                k += r + 1
                p[todo] = np.minimum(p[todo] + s, limit)
                left = (k < 64) & ((s > 0) | (r == 15))
                todo, k = todo[left], k[left]
                if len(todo):
                    p[todo], rs[todo] = take(p[todo], tables[16 + ac])
                    going = rs[todo] != 0
                    todo, k = todo[going], k[going]
            bit[:n] = p
    level = np.clip(np.rint(out * first.quant[parts[luma][2]] / 8) + 128, 0, 255).astype(np.uint8)
    lane = np.empty_like(order)
    lane[order] = np.arange(len(order))
    edges, thumbs = np.searchsorted(owner, np.arange(len(images) + 1)), []
    for i, (w, h) in enumerate(size):
        rows = lane[edges[i] : edges[i + 1]]
        flat = np.concatenate([level[r, : units[r] * per] for r in rows])[: w * h * per] if len(rows) != h or per > 1 or level.shape[1] != w else level[rows].ravel()
        bh, bv = (1, 1) if alone else parts[luma][:2]
        grid = flat.reshape(h, w, bv, bh).transpose(0, 2, 1, 3).reshape(h * bv, w * bh)
        im = images[i]
        thumbs.append(grid[: -(-im.height * (bv if not alone else 1) // (8 * (vmax if not alone else 1))), : -(-im.width * (bh if not alone else 1) // (8 * (hmax if not alone else 1)))])
    return thumbs


def thumbnails(media: list[bytes]) -> list[list[tuple[int, int, np.ndarray]] | None]:
    """Width, height and DC-only luminance thumbnail of each image in each value; None where a value can't be read."""
    out: list = [None] * len(media)
    alike: dict[tuple, list[tuple[int, int, Image]]] = {}
    for i, data in enumerate(media):
        try:
            images = parse(data)
        except (ValueError, IndexError, struct.error):
            continue
        out[i] = [None] * len(images)
        for k, im in enumerate(images):
            alike.setdefault((tuple(im.parts), tuple(im.scan), tuple(sorted(im.tables.items())), tuple(sorted(im.quant.items()))), []).append((i, k, im))
    for group in alike.values():
        try:
            for (i, k, im), thumb in zip(group, _decode_alike([x[2] for x in group])):
                out[i][k] = (im.width, im.height, thumb)
        except (KeyError, ValueError, IndexError):
            for i, _, im in group:
                out[i] = None if len(group) == 1 else (thumbnails([media[i]])[0] if out[i] is not None else None)
    return out


def thumbnail_hash(thumb: np.ndarray) -> int:
    """64 bits: which cells of an 8 x 8 grid over the thumbnail are brighter than the thumbnail's mean."""
    at = [np.linspace(0, n, 9).astype(int) for n in thumb.shape]
    sums = np.pad(thumb.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    low = [a[:-1] for a in at]
    high = [np.maximum(a[1:], a[:-1] + 1) for a in at]
    cells = sums[high[0][:, None], high[1]] - sums[low[0][:, None], high[1]] - sums[high[0][:, None], low[1]] + sums[low[0][:, None], low[1]]
    area = (high[0] - low[0])[:, None] * (high[1] - low[1])
    return int(np.packbits((cells * thumb.size > sums[-1, -1] * area).ravel()).view(">u8")[0])


def encode_media(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as JPEG, from which media_features gets it back byte by byte. Null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _TEXT_BYTES):
            own = texts(batch.column("text"))
            media = encode_payloads([t.ljust(max(ROW, -(-len(t) // ROW) * ROW), b" ") for t in own])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(t) for t in own], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(rows: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """The columns keep, and what reading the media column back gives: width, height, images, thumbnail and media figures.

    thumbnail (binary) has the images' thumbnails in turn, row by row; feature is WIDTHxHEIGHT, the first image's
    thumbnail hash and XXH64 of the thumbnail. For null media or what is no baseline JPEG of one scan, all are null but media_bytes
    and media_sha256 of a value that isn't null.
    """
    names = ["width", "height", "images", "thumbnail", "feature", "media_bytes", "media_sha256"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media__", 2 * _TEXT_BYTES):
            data, out = batch.column("media__").to_pylist(), []
            for own, images in zip(data, thumbnails([x or b"" for x in data])):
                seen = (None, None) if own is None else (len(own), hashlib.sha256(own).hexdigest())
                if not images:
                    out.append((None,) * 5 + seen)
                    continue
                whole = b"".join(np.ascontiguousarray(t).tobytes() for _, _, t in images)
                width, height = images[0][0], sum(x[1] for x in images)
                out.append((width, height, len(images), whole, f"{width}x{height}:{thumbnail_hash(images[0][2]):016x}:{xxhash.xxh64_hexdigest(whole)}", *seen))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f"keep{i}") for i in range(len(keep))), *columns], names=[*keep, *names])

    own = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    chosen = rows.select(*[F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)], F.col(media).alias("media__"))
    return chosen.mapInArrow(run, own + ", width int, height long, images int, thumbnail binary, feature string, media_bytes long, media_sha256 string")


def stored_texts(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """One row per row of docs: the text's stored form read back, as digests. Repeated rows give repeated, equal rows.

    An empty or null text is 192 bytes 32. Other columns are ignored. The text goes through two passes in one stage:
    nothing is shuffled, and a task holds a few MB of text at a time.
    """

    read = media_features(encode_media(docs, text, id_))
    return read.select("doc_id", "n_bytes", F.length("thumbnail").cast("long").alias("payload_bytes"), F.sha2("thumbnail", 256).alias("payload_sha256"),
                       F.crc32(F.expr("substring(thumbnail, -16)")).alias("tail_crc32"), "media_bytes", "media_sha256", "feature")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_texts(documents(spark, sf_dir))
