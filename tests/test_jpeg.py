"""JPEG decoding against files written by the JVM's own encoder."""

import numpy as np
import pytest

from foliospark.kernel import builder as b
from foliospark.kernel import extract as x
from foliospark.kernel import jpeg, pictures


def written(spark, pixels, path, progressive):
    jvm = spark._jvm
    height, width = pixels.shape[:2]
    grey = pixels.ndim == 2
    kind = jvm.java.awt.image.BufferedImage
    image = kind(width, height, kind.TYPE_BYTE_GRAY if grey else kind.TYPE_INT_RGB)
    for y in range(height):
        for px in range(width):
            if grey:
                image.getRaster().setSample(px, y, 0, int(pixels[y, px]))
            else:
                r, g, c = map(int, pixels[y, px])
                image.setRGB(px, y, r << 16 | g << 8 | c)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    settings = writer.getDefaultWriteParam()
    settings.setCompressionMode(2)
    settings.setCompressionQuality(0.95)
    if progressive:
        settings.setProgressiveMode(1)
    out = jvm.javax.imageio.stream.FileImageOutputStream(jvm.java.io.File(str(path)))
    writer.setOutput(out)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), settings)
    out.close()
    return path.read_bytes()


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("grey", [True, False])
def test_against_the_jvm(spark, tmp_path, grey, progressive):
    y, px = np.mgrid[0:29, 0:43]
    plane = (128 + 90 * np.sin(px / 9) * np.cos(y / 7)).astype(np.uint8)
    pixels = plane if grey else np.stack([plane, plane[::-1], (px * 5 % 256 // 2 + 60).astype(np.uint8)], axis=2)
    data = written(spark, pixels, tmp_path / "a.jpg", progressive)
    ours, inverted = jpeg.decode(data)
    assert ours.shape == (29, 43, 1 if grey else 3) and not inverted
    assert np.abs(ours.astype(int).squeeze() - pixels.astype(int)).mean() < (3 if grey else 9)
    theirs = spark.read.format("image").load(str(tmp_path / "a.jpg")).select("image.*").first()
    flat = np.frombuffer(theirs.data, np.uint8).reshape(theirs.height, theirs.width, theirs.nChannels)[:, :, ::-1]
    # Chroma is spread differently; the means are close.
    assert np.abs(ours.astype(int) - (flat[:, :, :1] if grey else flat).astype(int)).mean() < (1.5 if grey else 5)


def test_in_a_file(spark, tmp_path):
    data = written(spark, np.full((16, 16), 200, np.uint8), tmp_path / "b.jpg", False)
    objs = b.page_tree(1, 4, "/XObject <</I 6 0 R>>") | {5: b.stream("", b"q 10 0 0 10 0 0 cm /I Do Q"), 6: b.stream("/Subtype /Image /Width 16 /Height 16 /BitsPerComponent 8 /ColorSpace /DeviceGray /Filter /DCTDecode", data)}
    image = x.read(b.classic(objs), x.Options(images=True)).pages[0].images[0]
    assert image.filter == "DCTDecode" and abs(int(pictures.pixels(image).mean()) - 200) <= 1
    for cut in (0, 10, 100, len(data) // 2):
        objs[6] = b.stream("/Subtype /Image /Width 16 /Height 16 /BitsPerComponent 8 /ColorSpace /DeviceGray /Filter /DCTDecode", data[:cut])
        image = x.read(b.classic(objs), x.Options(images=True)).pages[0].images[0]
        try:
            pictures.pixels(image)
        except pictures.Unsupported:
            pass
