import hashlib
import random

import numpy as np
import pytest

from gavelworks.llm import jpeg
from gavelworks.llm.media import payload, read_media, store_texts

from frames import no_documents, odd_documents


def payloads():
    rng = np.random.default_rng(4)
    return [
        bytes(64),
        bytes(range(128)),
        b"\xff" * 640,
        bytes([0, 255] * 320),
        rng.integers(0, 256, 64 * 300).astype(np.uint8).tobytes(),
        rng.integers(0, 256, 64 * (jpeg.MOST_ROWS + 5)).astype(np.uint8).tobytes(),
    ]


def test_bytes_come_back():
    files = jpeg.store(payloads())
    for images, data in zip(jpeg.thumbnails(files), payloads()):
        assert b"".join(p.tobytes() for p in images) == data
    assert [len(i) for i in jpeg.thumbnails(files)] == [1, 1, 1, 1, 1, 2]


def java_image(spark, data):
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    width, height = image.getWidth(), image.getHeight()
    raster = image.getRaster()
    values = list(raster.getSamples(0, 0, width, height, 0, spark.sparkContext._gateway.new_array(jvm.int, width * height)))
    return np.array(values).reshape(height, width)


def test_another_reader_sees_the_bytes(spark):
    for data in payloads()[:4]:
        (file,) = jpeg.store([data])
        pixels = java_image(spark, file)
        rows = np.frombuffer(data, np.uint8).reshape(-1, 64)
        assert pixels.shape == (rows.shape[0] * 8, 512)
        assert (pixels == np.kron(rows, np.ones((8, 8), int))).all()


@pytest.mark.parametrize("width,height,grey", [(64, 48, True), (75, 53, True), (75, 53, False), (16, 200, False), (9, 9, False)])
def test_images_of_another_writer(spark, width, height, grey):
    """Real pictures: AC terms, no restarts, and colour with subsampled chroma."""
    jvm, rng = spark._jvm, random.Random(width)
    kind = jvm.java.awt.image.BufferedImage.TYPE_BYTE_GRAY if grey else jvm.java.awt.image.BufferedImage.TYPE_INT_RGB
    image = jvm.java.awt.image.BufferedImage(width, height, kind)
    for y in range(height):
        for x in range(width):
            v = 70 + (x * 3 + y * 2) % 80 + rng.randint(0, 40)  # far from black and white, where means are cut
            image.setRGB(x, y, (v << 16) | (v << 8) | v)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    data = bytes(out.toByteArray())
    ((found,),) = jpeg.thumbnails([data])
    assert found.shape == (-(-height // 8), -(-width // 8))
    # Blocks that lie wholly in the picture have its mean, but for rounding.
    pixels = java_image(spark, data)
    for y in range(height // 8):
        for x in range(width // 8):
            assert abs(pixels[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8].mean() - found[y, x]) < 1.5
    # Together with others of the same and of other tables.
    many = jpeg.thumbnails([data, jpeg.store([bytes(128)])[0], data])
    assert (many[0][0] == found).all() and (many[2][0] == found).all()


def test_hash_tells_light_from_dark():
    picture = np.zeros((16, 16), np.uint8)
    picture[:, 8:] = 200
    assert jpeg.average_hash(picture) == "0f" * 8
    assert jpeg.average_hash(np.full((1, 64), 9, np.uint8)) == "00" * 8


def test_odd_frames(spark):
    frame = odd_documents(spark)
    stored = store_texts(frame)
    rows = read_media(stored).withColumn("payload", payload()).collect()
    assert len(rows) == 11
    for r in rows:
        text = (r.text or "").encode()
        assert bytes(r.payload) == text + bytes(-len(text) % 64 if text else 64)
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text, set()).add(hashlib.sha256(r.media).hexdigest())
    assert all(len(v) == 1 for v in by_text.values())
    broken = spark.createDataFrame([(None,), (bytearray(b""),), (bytearray(b"no"),), (bytearray(b"\xff\xd8\xff"),)], "media binary")
    assert [r.images for r in read_media(broken).collect()] == [None, [], None, None]
    mixed = stored.select("media").limit(2).unionByName(broken)
    assert sum(r.images is not None and len(r.images) > 0 for r in read_media(mixed).collect()) == 2
    assert read_media(store_texts(no_documents(spark))).count() == 0
