import hashlib
import random
import zlib

import numpy as np
import pytest
from pagewright.llm import media, webp

rng = random.Random(3)


class Stream(webp.Writer):
    """Writes any lossless stream, for the reader's tests: literal ARGB symbols with fixed-length codes."""

    def fixed(self, size, used, bits):
        lengths = [0] * size
        for s in used:
            lengths[s] = bits
        self.code(np.array(lengths))

    def literal_codes(self, cache=0, lengths=(), far=None):
        if lengths or cache:  # 256 literals of 9 bits and 256 places of 9 bits for the rest
            rest = list(range(256, 256 + 24 + cache))
            n = len(rest)
            short = 512 - 256 - n
            own = [9] * 256 + [9] * n
            assert short >= 0
            while short:  # give spare codes away by shortening literals
                k = next(i for i, x in enumerate(own) if x == 9)
                own[k] = 8
                short -= 1
            self.green = own
        else:
            self.green = [8] * 256 + [0] * 24
        self.code(np.array(self.green))
        for _ in range(3):
            self.fixed(256, range(256), 8)
        if far is None:
            self.one(0)
        else:
            self.fixed(40, range(32), 5)
        self.codes = webp.canonical(self.green)

    def symbol(self, s):
        n, c = self.codes[s]
        self.put(webp.reverse(c, n), n)

    def argb(self, p):
        self.symbol(p >> 8 & 255)
        for shift in (16, 0, 24):
            self.put(webp.reverse(p >> shift & 255, 8), 8)

    def image(self, pixels, main=True):
        self.put(0, 1)
        if main:
            self.put(0, 1)
        self.literal_codes()
        for p in pixels:
            self.argb(p)

    def file(self):
        body = self.value.to_bytes(-(-self.at // 8), "little")
        chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + bytes(len(body) & 1)
        return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def start(width, height):
    w = Stream()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    return w


def noise(n):
    return [rng.getrandbits(32) for _ in range(n)]


def test_literals():
    pixels = noise(7 * 5)
    w = start(7, 5)
    w.put(0, 1)
    w.image(pixels)
    assert webp.read(w.file()).ravel().tolist() == pixels
    assert webp.read_many([w.file()])[0].ravel().tolist() == pixels


def test_back_references_and_cache():
    width, height = 16, 12
    w, out, bits = start(width, height), [], 4
    w.put(0, 1)
    w.put(1, 1)
    w.put(bits, 4)
    w.put(0, 1)
    w.literal_codes(cache=1 << bits, lengths=(1,), far=1)
    cache = [0] * (1 << bits)

    def add(p):
        out.append(p)
        cache[(p * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - bits)] = p

    total = width * height
    while len(out) < total:
        kind = rng.choice("lllcb") if out else "l"
        if kind == "l":
            p = noise(1)[0]
            w.argb(p)
            add(p)
        elif kind == "c":
            k = rng.randrange(1 << bits)
            w.symbol(256 + 24 + k)
            add(cache[k])
        else:
            n = rng.randint(1, min(20, total - len(out)))
            value = rng.randint(1, 200)
            back = webp._distance(value, width)
            if back > len(out):
                continue
            prefix, extra, rest = webp._prefix(n)
            w.symbol(256 + prefix)
            w.put(rest, extra)
            prefix, extra, rest = webp._prefix(value)
            w.put(webp.reverse(prefix, 5), 5)
            w.put(rest, extra)
            for _ in range(n):
                add(out[-back])
    assert webp.read(w.file()).ravel().tolist() == out


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    """The forward transform is written from the definition, pixel by pixel."""
    width, height, size = 9, 6, 2
    pixels = noise(width * height)

    def channel(p, i):
        return p >> 8 * i & 255

    def guess(x, y):
        at = lambda x, y: pixels[y * width + x]
        if x == y == 0:
            return 0xFF000000
        if y == 0:
            return at(x - 1, 0)
        if x == 0:
            return at(0, y - 1)
        a, t, c, r = at(x - 1, y), at(x, y - 1), at(x - 1, y - 1), pixels[(y - 1) * width + x + 1]
        mean = lambda p, q: sum((channel(p, i) + channel(q, i)) // 2 << 8 * i for i in range(4))
        clip = lambda v: min(255, max(0, v))
        if mode == 11:
            plane = [channel(a, i) + channel(t, i) - channel(c, i) for i in range(4)]
            pa, pt = (sum(abs(plane[i] - channel(q, i)) for i in range(4)) for q in (a, t))
            return a if pa < pt else t
        if mode == 12:
            return sum(clip(channel(a, i) + channel(t, i) - channel(c, i)) << 8 * i for i in range(4))
        if mode == 13:
            m = mean(a, t)
            return sum(clip(channel(m, i) + int((channel(m, i) - channel(c, i)) / 2)) << 8 * i for i in range(4))
        return [0xFF000000, a, t, r, c, mean(mean(a, r), t), mean(a, c), mean(a, t), mean(c, t), mean(t, r), mean(mean(a, c), mean(t, r))][mode]

    coded = [sum((channel(pixels[i], k) - channel(guess(i % width, i // width), k) & 255) << 8 * k for k in range(4)) for i in range(width * height)]
    w = start(width, height)
    w.put(1, 1)
    w.put(webp.PREDICTOR, 2)
    w.put(size - 2, 3)
    w.image([mode << 8] * (3 * 2), main=False)
    w.put(0, 1)
    w.image(coded)
    assert webp.read(w.file()).ravel().tolist() == pixels


def test_colour_transforms_and_meta_codes():
    width, height, size = 10, 7, 2
    pixels = noise(width * height)
    blocks = [0xFF000000 | rng.getrandbits(24) for _ in range(3 * 2)]
    signed = lambda v: v - 256 if v > 127 else v
    coded = []
    for i, p in enumerate(pixels):
        a, r, g, b = p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255
        r, b = r - g & 255, b - g & 255
        e = blocks[(i // width >> size) * 3 + (i % width >> size)]
        b = b - (signed(e >> 8 & 255) * signed(g) >> 5) - (signed(e >> 16 & 255) * signed(r) >> 5) & 255
        r = r - (signed(e & 255) * signed(g) >> 5) & 255
        coded.append(a << 24 | r << 16 | g << 8 | b)
    w = start(width, height)
    w.put(1, 1)
    w.put(webp.SUBTRACT_GREEN, 2)
    w.put(1, 1)
    w.put(webp.CROSS_COLOUR, 2)
    w.put(size - 2, 3)
    w.image(blocks, main=False)
    w.put(0, 1)
    w.put(0, 1)
    w.put(1, 1)  # meta codes: two groups
    w.put(0, 3)
    w.image([(k % 2) << 8 for k in range(3 * 2)], main=False)
    w.literal_codes()
    w.literal_codes()
    for p in coded:
        w.argb(p)
    assert webp.read(w.file()).ravel().tolist() == pixels


@pytest.mark.parametrize("colours", [2, 3, 16, 17, 256])
def test_palette(colours):
    width, height = 13, 5
    table = noise(colours)
    index = [rng.randrange(colours) for _ in range(width * height)]
    per = 8 if colours <= 2 else 4 if colours <= 4 else 2 if colours <= 16 else 1
    coded = []
    for y in range(height):
        row = index[y * width : (y + 1) * width]
        coded += [sum(v << k * (8 // per) for k, v in enumerate(row[x : x + per])) << 8 for x in range(0, width, per)]
    deltas = [sum(((table[i] >> 8 * k & 255) - (table[i - 1] >> 8 * k & 255 if i else 0) & 255) << 8 * k for k in range(4)) for i in range(colours)]
    w = start(width, height)
    w.put(1, 1)
    w.put(webp.PALETTE, 2)
    w.put(colours - 1, 8)
    w.image(deltas, main=False)
    w.put(0, 1)
    w.image(coded)
    assert webp.read(w.file()).ravel().tolist() == [table[i] for i in index]


def test_corrupt():
    good = webp.write_bytes(np.frombuffer(b"some bytes, all different" * 24, np.uint8)[:576], 96)
    for bad in (b"", b"RIFF", good[:30], good[:-40], good[:20] + b"\0" + good[21:]):
        with pytest.raises(webp.Corrupt):
            webp.read(bad)


def test_payloads():
    for n in (576, 96 * 96):
        for data in (bytes(rng.randrange(256) for _ in range(n)), b"\xff" * n, b"ab" * (n // 2), b"a" * (n - 9) + b"\xff" * 9, bytes(range(256)) * (n // 256) + bytes(n % 256)):
            file = webp.write_bytes(np.frombuffer(data, np.uint8), 96)
            image = webp.read(file)
            assert image.shape == (n // 96, 96) and (image.ravel() >> 8 & 255).astype(np.uint8).tobytes() == data
            assert (webp.read_many([file, file])[1] == image).all()


def test_every_step_is_written(spark, sf_dir):
    """Files of the table have predictor, cross-colour, back-references and colour cache, and the reader undoes them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(200)
    rows = media.store(docs).collect()
    files = [bytes(f) for r in rows for f in r.files]
    seen = {"cache": 0, "copies": 0, "modes": set(), "multipliers": set()}
    for f in files:
        head = webp._Head(f)
        assert [kind for kind, _, _ in head.transforms] == [webp.PREDICTOR, webp.CROSS_COLOUR]
        (_, _, (_, modes)), (_, _, (_, multipliers)) = head.transforms
        seen["modes"] |= {m >> 8 & 15 for m in modes}
        seen["multipliers"] |= {m & 0xFFFFFF for m in multipliers}
        cache = head.bits.read(4) if head.bits.read(1) else 0
        assert not head.bits.read(1)
        codes = [webp.read_code(head.bits, n) for n in (280 + (1 << cache if cache else 0), 256, 256, 256, 40)]
        used = {int(x) >> 4 for x in codes[0].table}
        seen["copies"] += any(256 <= s < 280 for s in used)
        seen["cache"] += any(s >= 280 for s in used)
    assert seen["cache"] > len(files) // 2 and seen["copies"] > len(files) // 2
    assert len(seen["modes"]) > 1 and len(seen["multipliers"]) > 1


def test_written_images():
    """Smooth, grey, noisy and repeated pictures come back from both readers, and shrink where there is something to gain."""
    y, x = np.mgrid[0:50, 0:40]
    smooth = np.stack([x * 3 + y, x + y * 2, 250 - x - y], 2).astype(np.uint8)
    grey = np.repeat(np.random.default_rng(1).integers(0, 256, (37, 40, 1), np.uint8), 3, 2)
    loud = np.random.default_rng(2).integers(0, 256, (1, 40, 3), np.uint8)
    again = np.tile(np.random.default_rng(3).integers(0, 256, (5, 40, 3), np.uint8), (9, 1, 1))
    images = [smooth, grey, loud, again, np.zeros((200, 40, 3), np.uint8), smooth[:1], smooth]
    files = webp.write_many(images)
    for image, file, other in zip(images, files, webp.read_many(files)):
        argb = webp.read(file)
        want = image.astype(np.int64)
        assert (argb == (0xFF000000 | want[:, :, 0] << 16 | want[:, :, 1] << 8 | want[:, :, 2])).all() and (argb == other).all()
        assert (media.samples(argb) == image.ravel()).all()
    assert len(files[0]) < smooth.size / 8 and len(files[1]) < grey.size / 2 and len(files[3]) < again.size / 3
    assert files[0] == files[-1] == webp.write(smooth)


def expected(text):
    data = (text or "").encode()
    payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: expected(r.text) for r in docs.collect()}
    rows = media.media_columns(docs).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in rows} == want and len(rows) == len(want)
    assert sum(r.media_bytes for r in rows) < 0.8 * sum(r.payload_bytes for r in rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a" * 576), (3, "a" * 576), (None, "é🙂"), (4, "long text " * 20_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, files string")
    got = media.media_columns(docs).collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:5]) for r in got) == sorted((str(d), *expected(t)) for d, t in rows)
    assert len({tuple(r)[1:] for r in got if r.doc_id == 3}) == 1
    held = media.read_back(media.store(docs), with_pixels=True).where("doc_id = 4").first().pixels
    assert bytes(held).startswith(b"long text ") and media.media_columns(docs.limit(0)).count() == 0


def test_lengths_of_the_writers_codes_are_read_several_at_a_time():
    """The table of steps gives what the loop of single lengths gives, and takes the same bits."""
    assert len(webp._own_steps()) == 1 << webp.OWN_STEP and min(n for _, _, n in webp._own_steps()) >= 1
    rng = np.random.default_rng(6)
    for used in (3, 5, 40, 150, 256):
        counts = np.zeros(256, np.int64)
        counts[rng.choice(256, used, replace=False)] = rng.integers(1, 500, used)
        w = webp.Writer()
        size, _ = webp._put_code(w, counts)
        w.put(0b1011, 4)
        bits = webp.Bits(w.value.to_bytes(-(-w.at // 8), "little"))
        code = webp.read_code(bits, 256)
        assert bits.at == w.at - 4 and (code.table == webp.Code(size.tolist()).table).all()


def test_keys_in_order():
    """Equal keys by place, as a stable sort has them; a key whose lower bits don't matter loses nothing."""
    rng = np.random.default_rng(7)
    keys = rng.integers(0, 50, 3000).astype(np.uint64) << np.uint64(40)
    upper, order = webp._in_order(keys)
    assert (order == np.argsort(keys, kind="stable")).all() and (upper == keys[order] >> np.uint64(12)).all()
