"""An OCR engine for ``Options.ocr`` that runs the ``tesseract`` program.

The largest image of a page is written as a grey map, read by the program, and
its words are placed on the page through the image's matrix.
"""

from __future__ import annotations

import math
import os
import subprocess
from dataclasses import dataclass

import numpy as np

from foliospark.kernel import pictures
from foliospark.kernel.interpreter import Run

SMALLEST = 16


@dataclass(frozen=True)
class Engine:
    """``Options(ocr=Engine("eng+deu"), ocr_policy="textless")``."""

    languages: str = "eng"
    program: str = "tesseract"
    least_confidence: float = 0.0
    seconds: float = 120.0

    def __call__(self, page) -> list[Run]:
        usable = [i for i in page.images if i.width >= SMALLEST and i.height >= SMALLEST]
        if not usable:
            return []
        image = max(usable, key=lambda i: i.width * i.height)
        grey = pictures.pixels(image).mean(axis=2).astype(np.uint8)
        header = b"P5 %d %d 255\n" % (grey.shape[1], grey.shape[0])
        command = [self.program, "-", "-", "-l", self.languages, "--dpi", str(dpi(image)), "tsv"]
        done = subprocess.run(command, input=header + grey.tobytes(), capture_output=True, timeout=self.seconds, env=os.environ | {"OMP_THREAD_LIMIT": "1"})
        if done.returncode:
            raise RuntimeError((done.stderr.decode("utf-8", "replace").strip().splitlines() or ["failed"])[-1])
        return words(image, done.stdout.decode("utf-8", "replace"), self.least_confidence)


def dpi(image) -> int:
    """Pixels to the inch, from how wide the image is painted; 70 to 2400."""
    a, b = image.ctm[:2]
    painted = math.hypot(a, b)
    return min(2400, max(70, round(image.width / painted * 72))) if painted > 0 else 300


def words(image, tsv: str, least_confidence: float = 0.0) -> list[Run]:
    """Word rows (level 5) of tab-separated output as glyphs on the page."""
    out = []
    for line in tsv.splitlines():
        f = line.split("\t")
        if len(f) != 12 or f[0] != "5" or not f[11].strip():
            continue
        try:
            left, top, width, height, confidence = map(float, f[6:11])
        except ValueError:
            continue
        if confidence < least_confidence or width <= 0 or height <= 0:
            continue
        x0, y0 = image.to_page(left, top + height)
        x1, y1 = image.to_page(left + width, top + height)
        x2, y2 = image.to_page(left, top)
        length = math.hypot(x1 - x0, y1 - y0)
        direction = ((x1 - x0) / length, (y1 - y0) / length) if length > 0 else (1.0, 0.0)
        out.append(Run([f[11].strip()], np.array([x0]), np.array([y0]), np.array([length]), math.hypot(x2 - x0, y2 - y0), direction, (x2 - x0, y2 - y0), origin="ocr"))
    return out
