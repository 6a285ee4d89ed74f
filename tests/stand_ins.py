"""Models for the tests: what they find is drawn on the page in fixed colours."""

import numpy as np

from quire.operators import inference

INK = {(0, 0, 0): 1, (1, 0, 0): 2, (0, 1, 0): 3, (255, 0, 0): 2, (0, 255, 0): 3, (0, 0, 255): 4, (255, 0, 255): 5}


def region(x):
    """Colours are labels; rows of black within 16 pixels are one paragraph."""
    a = np.rint(x * 255).astype(int)
    out = np.zeros((*x.shape[:3], 6), np.float32)
    out[..., 0] = 0.5
    for colour, k in INK.items():
        m = (a == colour).all(-1)
        if k == 1:
            for y in range(1, 9):
                m[:, y:] |= m[:, :-y].copy()
        out[..., k] = np.maximum(out[..., k], m * 0.9)
    return out


def lines(x):
    dark = (np.rint(x * 255).astype(int) <= 1).all(-1)
    return np.stack([1 - dark, dark], -1).astype(np.float32)


def frame(x):
    inside = np.zeros(x.shape[:3])
    inside[:, 5:-5, 5:-5] = 1
    return np.stack([1 - inside, inside], -1)


def reader(x):
    return np.repeat(np.array([[[0.9, 0.1, 0.0], [0.0, 0.1, 0.9], [0.1, 0.8, 0.1]]]), len(x), 0)


def right_first(x):
    """A region that stands further right comes before another; of equal ones the first."""
    at = lambda m: np.array([np.flatnonzero(((k > 0.3) & (k < 0.4)).any(0))[:1].sum() for k in m])
    return (at(x[..., 0]) >= at(x[..., 2])).astype(float)[:, None]


def registry(base="."):
    zoo = inference.Registry(base)
    for category, model in (("region", region), ("textline", lines), ("page", frame), ("binarization", lines), ("enhancement", lambda x: x[0:1] if x.ndim == 4 else x), ("ocr", reader)):
        zoo.add(inference.Spec(category, filename=f"{category}.npz", help=f"finds {category}"), lambda path, model=model: model)
    return zoo


def with_order(base="."):
    zoo = registry(base)
    zoo.add(inference.Spec("reading_order"), lambda path: right_first)
    return zoo


def page(h=900, w=1600):
    """Two columns of two paragraphs under a heading, an image at the foot, a marginal note."""
    a = np.full((h, w, 3), 255, np.uint8)
    a[60:90, 200:1400] = (255, 0, 0)
    for x in (200, 900):
        for top in (200, 460):
            for y in range(top, top + 160, 16):
                a[y : y + 9, x : x + 500] = 0
    a[70:76, 220:1380] = (1, 0, 0)  # the heading's line
    a[700:860, 500:900] = (0, 0, 255)
    a[300:340, 60:120] = (0, 255, 0)
    a[305:311, 64:116] = (0, 1, 0)
    return a
