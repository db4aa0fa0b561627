"""JPEG and GIF files, written by Java, against what was drawn."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators.fits import Refused
from tidemark.sources.readers import image_samples, read_images


def draw(spark, path, kind, colours, gray=False):
    """colours: rows of (red, green, blue)."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(len(colours[0]), len(colours), 10 if gray else 1)
    for y, row in enumerate(colours):
        for x, (r, g, b) in enumerate(row):
            image.setRGB(x, y, (r << 16) + (g << 8) + b)
    assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(str(path)))


def test_photographs_and_pictures_are_read(spark, tmp_path):
    for c in ("cat", "dog"):
        (tmp_path / c).mkdir()
    flags = [[(255, 0, 0)] * 8 + [(0, 0, 255)] * 8] * 16  # whole blocks of one colour survive JPEG nearly as they are
    draw(spark, tmp_path / "cat" / "1.jpg", "jpg", flags)
    draw(spark, tmp_path / "dog" / "2.gif", "gif", flags)
    draw(spark, tmp_path / "dog" / "3.jpeg", "jpg", [[(90, 90, 90)] * 16] * 16, gray=True)
    draw(spark, tmp_path / "dog" / "4.png", "png", flags)
    got = read_images(spark, str(tmp_path), 16, 16, 3).collect()
    assert [(r.label, r.cat, r.dog) for r in got] == [("cat", 1.0, 0.0)] + [("dog", 0.0, 1.0)] * 3
    seen = [(np.array(r.media).reshape(16, 16, 3) + 1) * 127.5 for r in got]
    want = np.array(flags, float)
    assert np.abs(seen[0] - want)[:, [0, 1, 2, 13, 14, 15]].max() < 40 and np.abs(seen[1] - want).max() < 1e-3 and np.abs(seen[3] - want).max() < 1e-3
    assert np.ptp(seen[2]) < 1e-3
    one = (np.array(read_images(spark, str(tmp_path), 16, 16, 1).collect()[1].media).reshape(16, 16) + 1) * 127.5
    assert np.allclose(one[0, :8], 76) and np.allclose(one[0, 8:], 29)
    with pytest.raises(Exception, match="an image of 16x16, not 8x8"):
        read_images(spark, str(tmp_path), 8, 8, 3).collect()


def test_what_cannot_be_decoded_is_refused(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.jpg").write_bytes(b"no image")
    with pytest.raises(Exception, match="no image that can be read"):
        read_images(spark, str(tmp_path), 1, 1, 3).collect()
    (tmp_path / "2.gif").write_bytes(b"x")
    with pytest.raises(Refused, match="no class"):
        read_images(spark, str(tmp_path), 1, 1, 3)


def test_samples():
    bgra = pd.Series([bytes([10, 20, 30, 40])])
    told = lambda data, own, channels: ((np.array(image_samples(data, pd.Series([own]), channels)[0]) + 1) * 127.5).round(6).tolist()
    assert told(bgra, 4, 4) == [30, 20, 10, 40] and told(bgra, 4, 3) == [30, 20, 10] and told(bgra, 4, 1) == [22]
    assert told(pd.Series([bytes([7])]), 1, 4) == [7, 7, 7, 255] and told(pd.Series([bytes([7])]), 1, 1) == [7]
