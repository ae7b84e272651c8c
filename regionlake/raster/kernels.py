"""Numpy steps on one page or crop.  Everything that is a rule over their numbers is a Column elsewhere."""

from __future__ import annotations

import numpy as np


def round_half_up(a):
    return np.floor(np.asarray(a, dtype=np.float64) + 0.5)


def gray_of(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Gray values (bytes of gray images, else 0..255 as float) of an image row with gray, BGR or BGRA bytes."""
    px = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return px[:, :, 0]
    px = px.astype(np.float64)
    return 0.114 * px[:, :, 0] + 0.587 * px[:, :, 1] + 0.299 * px[:, :, 2]


# ---------------------------------------------------------------- size
def _axis_weights(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.linspace(0, n, m + 1)
    return edges[:-1], edges[1:]


def _area_mean(a: np.ndarray, m: int) -> np.ndarray:
    """Mean of ``a`` over m equal spans of its first axis, with fractional ends."""
    # bytes are summed exactly in integers
    whole = np.int32 if a.shape[0] < 8_000_000 else np.int64
    total = np.zeros((a.shape[0] + 1,) + a.shape[1:], whole if a.dtype == np.uint8 else np.float64)
    np.cumsum(a, axis=0, dtype=total.dtype, out=total[1:])
    lo, hi = _axis_weights(a.shape[0], m)

    def at(pos):
        i = np.minimum(pos.astype(int), a.shape[0] - 1)
        return total[i] + (pos - i)[:, None] * a[i]

    return (at(hi) - at(lo)) / (hi - lo)[:, None]


def _linear(a: np.ndarray, m: int) -> np.ndarray:
    pos = np.clip((np.arange(m) + 0.5) * a.shape[0] / m - 0.5, 0, a.shape[0] - 1)
    i = np.minimum(pos.astype(int), max(a.shape[0] - 2, 0))
    j = np.minimum(i + 1, a.shape[0] - 1)
    t = (pos - i)[:, None]
    return a[i] * (1 - t) + a[j] * t


def resize(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    """Area mean when shrinking, linear when growing, per axis."""
    fit = lambda a, m: a if m == a.shape[0] else (_area_mean if m < a.shape[0] else _linear)(a, m)
    return fit(np.ascontiguousarray(fit(gray, height).T), width).T.astype(np.float64, copy=False)


# ---------------------------------------------------------------- clean-up
def median3(gray: np.ndarray) -> np.ndarray:
    """3 x 3 median; the border stays."""
    h, w = gray.shape
    if h < 3 or w < 3:
        return gray
    a, b, c = gray[:-2], gray[1:-1], gray[2:]
    small, big = np.minimum(a, b), np.maximum(a, b)
    low, rest = np.minimum(small, c), np.maximum(small, c)
    mid, high = np.minimum(rest, big), np.maximum(rest, big)
    three = lambda v: (v[:, :-2], v[:, 1:-1], v[:, 2:])
    out = gray.copy()
    out[1:-1, 1:-1] = _middle(
        np.maximum(np.maximum(*three(low)[:2]), three(low)[2]), _middle(*three(mid)),
        np.minimum(np.minimum(*three(high)[:2]), three(high)[2]))
    return out


def _middle(a, b, c):
    return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))


def histogram(gray: np.ndarray) -> np.ndarray:
    if gray.dtype != np.uint8:
        return np.bincount(round_half_up(gray).astype(np.int64).ravel(), minlength=256)[:256]
    flat = gray.ravel()
    if flat.size < 1 << 16:
        return np.bincount(flat, minlength=256)
    # two bytes are counted at a time
    pairs = np.bincount(flat[:flat.size & ~1].view(np.uint16), minlength=1 << 16).reshape(256, 256)
    return pairs.sum(0) + pairs.sum(1) + np.bincount(flat[flat.size & ~1:], minlength=256)


def equalize(gray: np.ndarray) -> np.ndarray:
    """Histogram equalisation; a flat image stays as it is."""
    cdf = np.cumsum(histogram(gray))
    first = cdf[cdf > 0][0]
    if gray.size == first:
        return gray
    table = round_half_up((cdf - first) / (gray.size - first) * 255)
    if gray.dtype == np.uint8:
        level = np.arange(256)
        new = np.clip(round_half_up(level * (table / np.maximum(1, level))), 0, 255).astype(np.uint8)
        return np.frombuffer(gray.tobytes().translate(new.tobytes()), np.uint8).reshape(gray.shape)
    level = round_half_up(gray).astype(np.int64)
    ratio = table[level] / np.maximum(1, level)
    return np.clip(round_half_up(gray * ratio), 0, 255)


def sharpen(gray: np.ndarray) -> np.ndarray:
    h, w = gray.shape
    if h < 3 or w < 3:
        return gray
    out = gray.copy()
    # bytes are summed exactly in 16-bit integers
    wide = gray.astype(np.int16 if gray.dtype == np.uint8 else np.float64)
    c = wide[1:-1, 1:-1]
    out[1:-1, 1:-1] = np.clip(5 * c - wide[:-2, 1:-1] - wide[2:, 1:-1] - wide[1:-1, :-2] - wide[1:-1, 2:], 0, 255)
    return out


def otsu(gray: np.ndarray, flat: int = 128) -> int:
    """First threshold of maximal between-class variance; ``flat`` for an image of one value."""
    hist = histogram(gray).astype(np.float64)
    w0 = np.cumsum(hist)
    s0 = np.cumsum(hist * np.arange(256))
    w1 = hist.sum() - w0
    ok = (w0 > 0) & (w1 > 0)
    var = np.zeros(256)
    var[ok] = w0[ok] * w1[ok] * (s0[ok] / w0[ok] - (s0[-1] - s0[ok]) / w1[ok]) ** 2
    return int(var.argmax()) if var.max() > 0 else flat


def window_sum(gray: np.ndarray, half: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Sum and size of a window of 2 * half + 1, clipped at the border.

    Byte images are summed exactly in small integers, by windows of twice the length at a time; others from an integral image.
    """
    h, w = gray.shape
    d = 2 * half + 1
    size = lambda n: np.minimum(np.arange(n) + half + 1, n) - np.maximum(np.arange(n) - half, 0)
    if gray.dtype == np.uint8:
        kind = np.uint16 if d * d * 265 < 1 << 16 else np.int64
        wide = np.zeros((h + 2 * half, w), kind)
        wide[half:half + h] = gray
        tall = np.zeros((h, w + 2 * half), kind)
        tall[:, half:half + w] = _sum_of(wide, d, 0)
        return _sum_of(tall, d, 1), (size(h)[:, None] * size(w)[None, :]).astype(kind)
    s = np.zeros((h + d, w + d))
    inner = s[half + 1:half + 1 + h, half + 1:half + 1 + w]
    np.cumsum(gray, axis=0, out=inner)
    np.cumsum(inner, axis=1, out=inner)
    s[half + 1:half + 1 + h, half + 1 + w:] = inner[:, -1:]
    s[half + 1 + h:] = s[half + h]
    band = s[d:] - s[:-d]
    return band[:, d:] - band[:, :-d], (size(h)[:, None] * size(w)[None, :]).astype(np.float64)


def _sum_of(a: np.ndarray, d: int, axis: int) -> np.ndarray:
    """Sums of d consecutive values along an axis."""
    part = lambda x, at, n: x[at:at + n] if axis == 0 else x[:, at:at + n]
    n = a.shape[axis] - d + 1
    out, done, span = None, 0, 1
    while True:
        if d & span:
            out = part(a, done, n) if out is None else out + part(a, done, n)
            done += span
        if done == d:
            return out
        a = part(a, 0, a.shape[axis] - span) + part(a, span, a.shape[axis] - span)
        span *= 2


def binarize(gray: np.ndarray, method: str, fixed: int = 180) -> np.ndarray:
    """Ink mask: darker than the local mean less 10, than Otsu's threshold, or than a fixed one."""
    if method == "adaptive":
        total, size = window_sum(gray)
        if gray.dtype == np.uint8:
            return (gray + size.dtype.type(10)) * size < total
        return gray * size < total - 10 * size
    if method == "otsu":
        return round_half_up(gray) < otsu(gray)
    return gray < fixed


def is_blank(gray: np.ndarray) -> bool:
    """Gray values of all pixels hardly vary and are near black or white."""
    if not gray.size:
        return True
    s = gray if gray.dtype == np.uint8 else round_half_up(gray)
    return bool(int(s.max()) - int(s.min()) < 6 and (s.mean() < 10 or s.mean() > 245))


def quality(gray: np.ndarray) -> tuple[float, float, float]:
    """Sharpness (from the Laplacian), contrast and brightness.  Bytes are summed exactly in integers."""
    exact = gray.dtype == np.uint8
    gray = gray.astype(np.int16 if exact else np.float64)
    h, w = gray.shape
    sharp = 0.0
    if h > 2 and w > 2:
        around = sum(gray[dy:h - 2 + dy, dx:w - 2 + dx] for dy in range(3) for dx in range(3))
        edge = 9 * gray[1:-1, 1:-1] - around
        square = np.square(edge, dtype=np.int32).sum(dtype=np.int64) / edge.size if exact else np.mean(edge ** 2)
        sharp = min(100.0, float(np.sqrt(square)) / 10)
    return sharp, float((gray.max() - gray.min()) / 255 * 100), float(gray.mean())


# ---------------------------------------------------------------- components
def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of the connected component of each of n nodes, by first node; ``a`` and ``b`` are the ends of the links."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return (np.cumsum(root == np.arange(n)) - 1)[root]


def label(ink: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row runs of a mask and the component of each: (row, first x, last x + 1, component number)."""
    row, lo, hi = run_ends(ink)
    return row, lo, hi, label_runs(row, lo, hi, ink.shape[1], diagonal)


def _spans(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and value of the numbers first, first + 1, ... of each owner."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) + np.repeat(first - np.cumsum(count) + count, count)


def label_runs(row: np.ndarray, lo: np.ndarray, hi: np.ndarray, w: int, diagonal: bool = True) -> np.ndarray:
    """Component number of each run; runs are in order of (row, lo)."""
    n = len(row)
    if n == 0:
        return np.zeros(0, np.int64)
    reach = 1 if diagonal else 0
    # runs of the next row that touch run i form one consecutive span, found by key = row * (w + 2) + x
    base = (row + 1) * (w + 2)
    first = np.searchsorted(row * (w + 2) + hi, base + lo - reach, side="right")
    last = np.searchsorted(row * (w + 2) + lo, base + hi + reach, side="left")
    return _joined(n, *_spans(first, np.maximum(last - first, 0)))


def components(ink: np.ndarray, min_pixels: int, diagonal: bool = True) -> np.ndarray:
    """Rows (x0, y0, x1, y1, pixels) of components, ends included, in scan order."""
    row, lo, hi, comp = label(ink, diagonal)
    if not len(comp):
        return np.zeros((0, 5), np.int64)
    k = comp.max() + 1
    big = max(ink.shape) + 1
    out = np.empty((k, 5), np.int64)
    for col, values, ufunc, start in ((0, lo, np.minimum, big), (1, row, np.minimum, big),
                                      (2, hi - 1, np.maximum, -1), (3, row, np.maximum, -1)):
        acc = np.full(k, start)
        ufunc.at(acc, comp, values)
        out[:, col] = acc
    out[:, 4] = np.bincount(comp, weights=hi - lo, minlength=k)
    return out[out[:, 4] >= min_pixels]


def _near(boxes: np.ndarray, m: np.ndarray, gap_x: int, gap_y: int) -> np.ndarray:
    """Whether boxes lie within the gaps of others (ends included): at most gap_x apart, overlapping or less than gap_y apart.

    ``boxes`` and ``m`` are columns x0, y0, x1, y1 of whole numbers.
    """
    near = (boxes[2] >= m[0] - gap_x) & (boxes[0] <= m[2] + gap_x)
    gap = max(gap_y, 1)  # whole numbers overlap or touch where they are less than one apart
    near &= boxes[1] < m[3] + gap
    near &= boxes[3] > m[1] - gap
    return near


def _near_links(boxes: np.ndarray, gap_x: int, gap_y: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of boxes, sorted by their tops, within the gaps; a stretch of boxes is held against those that begin above its end."""
    reach = np.maximum.accumulate(boxes[:, 3])
    sides = np.ascontiguousarray(boxes[:, :4].T)
    rows = min(256, max(1, (1 << 20) // max(1, len(boxes))))
    a, b = [], []
    for at in range(0, len(boxes), rows):
        first = np.searchsorted(reach, boxes[at, 1] - gap_y, side="left")
        last = min(at + rows, len(boxes))
        i, j = np.divmod(np.flatnonzero(_near(sides[:, at:last, None], sides[:, None, first:last], gap_x, gap_y)), last - first)
        a.append(i + at)
        b.append(j + first)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def merge_boxes(boxes: np.ndarray, gap_x: int, gap_y: int) -> np.ndarray:
    """Grow the first unused box (from the top) over all unused boxes within the gaps, to a fixpoint; repeat.

    Boxes near each other always end in one box, as a box that grows stays near whatever it was near to.  So groups of boxes
    that are linked are taken whole, and only what the growth itself reaches needs another look.
    """
    boxes = boxes[np.argsort(boxes[:, 1], kind="stable")]
    if not len(boxes):
        return np.zeros((0, 5), np.int64)
    group = _joined(len(boxes), *_near_links(boxes, gap_x, gap_y))
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(group.max() + 1))
    ends = [f.reduceat(boxes[order], starts, axis=0) for f in (np.minimum, np.maximum, np.add)]
    union = np.concatenate([ends[0][:, :2], ends[1][:, 2:4], ends[2][:, 4:]], axis=1)
    by_top = np.argsort(union[:, 1], kind="stable")
    if len(_near_links(union[by_top], gap_x, gap_y)[0]) == len(union):
        return union  # a group is near itself only, and a box within another one is no nearer than it
    free = np.ones(len(union), bool)
    out = []
    left, owner = np.ascontiguousarray(boxes[:, :4].T), group
    for g in range(len(union)):
        if not free[g]:
            continue
        m = union[g]
        free[g] = False
        if g % 64 == 0:
            left, owner = left[:, free[owner]], owner[free[owner]]
        while True:
            met = owner[_near(left, m, gap_x, gap_y) & free[owner]]
            if not len(met):
                break
            free[met] = False
            met = union[np.unique(met)]
            m = np.concatenate([np.minimum(m[:2], met[:, :2].min(0)), np.maximum(m[2:4], met[:, 2:4].max(0)), m[4:] + met[:, 4].sum()])
        out.append(m)
    return np.array(out)


# ---------------------------------------------------------------- profiles
def run_ends(ink: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and last column + 1 of every ink run along rows."""
    padded = np.zeros((ink.shape[0], ink.shape[1] + 2), bool)
    padded[:, 1:-1] = ink
    # every row starts and ends blank, so its changes are starts and ends in turn
    at = np.flatnonzero(padded[:, 1:] != padded[:, :-1])
    row = at // (ink.shape[1] + 1)
    x = at - row * (ink.shape[1] + 1)
    return row[::2], x[::2], x[1::2]


def _runs_in(runs: tuple, line: np.ndarray, start: np.ndarray, stop: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a page within stretches of its lines: stretch, first place, last place + 1 from its start; and runs a stretch.

    ``runs`` are those of `run_ends`; stretch i goes from ``start[i]`` to ``stop[i]``, that excluded, of line ``line[i]``.
    """
    run_line, run_lo, run_hi = runs
    first = np.searchsorted(run_line * key + run_hi, line * key + start, side="right")
    last = np.searchsorted(run_line * key + run_lo, line * key + stop - 1, side="right")
    count = np.maximum(last - first, 0)
    at, run = _spans(first, count)
    return at, np.maximum(run_lo[run] - start[at], 0), np.minimum(run_hi[run], stop[at]) - start[at], count


def _in_boxes(mask: np.ndarray, x0, y0, x1, y1) -> np.ndarray:
    """Set pixels of each box (last column and row excluded); 0 for empty boxes."""
    return np.array([np.count_nonzero(mask[b:d, a:c]) for a, b, c, d in zip(*(v.tolist() for v in (x0, y0, x1, y1)))], np.int64)


def _edges(ink: np.ndarray) -> np.ndarray:
    """Pixels with a steep gradient (Sobel); the border has none."""
    b = ink.astype(np.int8)
    out = np.zeros(ink.shape, bool)
    across = b[:, 2:] - b[:, :-2]
    along = b[2:] - b[:-2]
    gx = across[:-2] + 2 * across[1:-1] + across[2:]
    gy = along[:, :-2] + 2 * along[:, 1:-1] + along[:, 2:]
    out[1:-1, 1:-1] = gx * gx + gy * gy > 4
    return out


def profiles(ink: np.ndarray, boxes: np.ndarray) -> tuple[dict, dict, dict]:
    """Counts of the crops of a page that the feature Columns build on, and their tight boxes.

    ``boxes`` has rows (x0, y0, x1, y1), ends included.  All crops are counted together from the runs of ink along the rows and
    the columns of the page.  Returns one value a crop, the values of all rows of all crops, and those of all columns.
    """
    page_h, page_w = ink.shape
    n = len(boxes)
    x0, y0, x1, y1 = boxes[:, :4].T.astype(np.int64)
    w, h = x1 - x0 + 1, y1 - y0 + 1
    # a crop and a page row or column of each of its rows and columns
    rc, ry = _spans(y0, h)
    cc, cx = _spans(x0, w)
    first_row, first_col = np.cumsum(h) - h, np.cumsum(w) - w
    per = lambda at, values, size: np.bincount(at, weights=values, minlength=size).astype(np.int64)

    # along rows
    at, lo, hi, count = _runs_in(run_ends(ink), ry, x0[rc], x1[rc] + 1, page_w + 2)
    rows, row_sum = per(at, hi - lo, len(rc)), per(at, (lo + hi - 1) * (hi - lo) // 2, len(rc))
    some = np.nonzero(count)[0]
    begin = np.cumsum(count) - count
    row_lo, row_hi = w[rc].copy(), np.zeros(len(rc), np.int64)
    row_lo[some], row_hi[some] = lo[begin[some]], hi[begin[some] + count[some] - 1] - 1
    # the upper median of the lengths of a crop's runs
    crop = rc[at]
    per_crop = np.bincount(crop, minlength=n)
    lengths = (hi - lo)[np.lexsort((hi - lo, crop))]
    stroke = np.zeros(n, np.int64)
    inked = per_crop > 0
    stroke[inked] = lengths[(np.cumsum(per_crop) - per_crop + per_crop // 2)[inked]]
    # crops stand below each other with a row between them, so that one labelling serves all
    stack = np.arange(len(rc)) + rc
    tight = _tight(ink, boxes, crop, stack[at], lo, hi, w, h, first_row + np.arange(n))
    has_loop = _loops(rc, stack, at, lo, hi, count, begin, w, h, first_row + np.arange(n))
    ended = np.bincount(crop[hi < w[crop]], minlength=n)

    # along columns, from the page on its side
    at, lo, hi, _ = _runs_in(run_ends(np.ascontiguousarray(ink.T)), cx, y0[cc], y1[cc] + 1, page_h + 2)
    crop = cc[at]
    cols = per(at, hi - lo, len(cc))
    cols_low = per(at, np.maximum(hi - np.maximum(lo, (h * 0.2).astype(np.int64)[crop]), 0), len(cc))
    turns = per(at, (lo > 0).astype(np.int8) + (hi < h[crop]), len(cc))
    curvy = np.bincount(cc[turns >= 3], minlength=n)
    col_runs = np.bincount(crop, minlength=n)
    row_gaps = ended + h - cols[first_col]
    edges = np.zeros(n, np.int64)
    if page_h > 2 and page_w > 2:
        edges = _in_boxes(_edges(ink), x0 + 1, y0 + 1, x1, y1)

    top = (h * 0.3).astype(np.int64)
    sc, sy = _spans(top, np.maximum((h * 0.7).astype(np.int64) - top, 0))
    sx = np.clip(np.floor(w[sc] * (1 - (sy - h[sc] * 0.3) / (h[sc] * 0.4))), 0, w[sc] - 1).astype(np.int64)
    slant = np.bincount(sc[ink[y0[sc] + sy, x0[sc] + sx]], minlength=n)
    return ({"col_runs": col_runs, "row_gaps": row_gaps, "edges": edges, "stroke": stroke, "curvy_cols": curvy,
             "has_loop": has_loop, "slant": slant, **tight},
            {"rows": rows, "row_lo": row_lo, "row_hi": row_hi, "row_sum": row_sum}, {"cols": cols, "cols_low": cols_low})


def _tight(ink, boxes, crop, row, lo, hi, w, h, start) -> dict:
    """Padded union box of the components above 5 pixels of each crop, and its outline over its perimeter."""
    page_h, page_w = ink.shape
    n = len(boxes)
    comp = label_runs(row, lo, hi, int(w.max(initial=0)))
    size = np.bincount(comp, weights=hi - lo)
    seen = size[comp] > 5 if len(comp) else np.zeros(0, bool)
    owner, y = crop[seen], row[seen] - start[crop[seen]]
    far = page_h + page_w
    box = []
    for values, ufunc, none in ((lo[seen], np.minimum, far), (y, np.minimum, far), (hi[seen], np.maximum, 0), (y + 1, np.maximum, 0)):
        acc = np.full(n, none, np.int64)
        ufunc.at(acc, owner, values)
        box.append(np.where(acc == far, 0, acc))
    ax, ay, bx, by = box
    left, top = boxes[:, 0], boxes[:, 1]
    # ink is outline where a neighbour is blank, and at the border of its crop
    inner = np.zeros(ink.shape, bool)
    inner[1:-1, 1:-1] = ink[1:-1, 1:-1] & ink[:-2, 1:-1] & ink[2:, 1:-1] & ink[1:-1, :-2] & ink[1:-1, 2:]
    all_ink = _in_boxes(ink, left + ax, top + ay, left + bx, top + by)
    within = _in_boxes(inner, left + np.maximum(ax, 1), top + np.maximum(ay, 1), left + np.minimum(bx, w - 1), top + np.minimum(by, h - 1))
    outline = all_ink - within
    px, py = np.maximum(0, ax - 5), np.maximum(0, ay - 5)
    bw, bh = np.minimum(page_w, bx + 5) - px, np.minimum(page_h, by + 5) - py
    around = 2 * (bw + bh)
    share = np.where((outline > 0) & (bw != 0) & (bh != 0), np.minimum(1.0, outline / np.where(around == 0, 1, around)), 0.0)
    return {"bound_x": px, "bound_y": py, "bound_w": bw, "bound_h": bh, "tightness": share}


def _loops(rc, stack, at, lo, hi, count, begin, w, h, start) -> np.ndarray:
    """Whether a crop has a blank area, between 6 pixels and a third of it, that reaches beyond its border."""
    n = len(w)
    # blank stretches: before the first run of a row, between runs, after the last one
    line = np.repeat(np.arange(len(rc)), count + 1)
    run = np.arange(len(at)) + at  # the stretch before a run
    head = begin + np.arange(len(rc))
    lo_, hi_ = np.empty(len(line), np.int64), np.empty(len(line), np.int64)
    lo_[head], hi_[head + count] = 0, w[rc]
    lo_[run + 1], hi_[run] = hi, lo
    real = hi_ > lo_
    line, lo_, hi_ = line[real], lo_[real], hi_[real]
    comp = label_runs(stack[line], lo_, hi_, int(w.max(initial=0)), diagonal=False)
    if not len(comp):
        return np.zeros(n, bool)
    crop = rc[line]
    size = np.bincount(comp, weights=hi_ - lo_)
    y = stack[line] - start[crop]
    inside = (y > 0) & (y < h[crop] - 1) & (np.maximum(lo_, 1) < np.minimum(hi_, w[crop] - 1))
    inner = np.zeros(len(size), bool)
    inner[comp[inside]] = True
    good = inner[comp] & (size[comp] > 5) & (size[comp] < (h * w * 0.3)[crop]) & (h[crop] > 2) & (w[crop] > 2)
    out = np.zeros(n, bool)
    out[crop[good]] = True
    return out


def profile(ink: np.ndarray) -> dict:
    """`profiles` of one crop."""
    one, rows, cols = profiles(ink, np.array([[0, 0, ink.shape[1] - 1, ink.shape[0] - 1]]))
    return rows | cols | {name: v[0].item() for name, v in one.items()}


def tight_box(ink: np.ndarray, page_w: int, page_h: int) -> tuple[int, int, int, int, float]:
    """R8 of one crop of a page of the given size."""
    page = np.zeros((page_h, page_w), bool)
    h, w = ink.shape
    page[:h, :w] = ink
    one = profiles(page, np.array([[0, 0, w - 1, h - 1]]))[0]
    return tuple(one[n][0].item() for n in ("bound_x", "bound_y", "bound_w", "bound_h", "tightness"))


# ---------------------------------------------------------------- R9
def refine_density(gray: np.ndarray, box, has_scripts: bool, has_fraction: bool, has_large: bool) -> tuple:
    """Box grown by a fifth, trimmed to dense rows and columns, extended for scripts, fractions and big symbols."""
    page_h, page_w = gray.shape
    x, y, w, h = (int(v) for v in box)
    ex, ey = int(w * 0.2), int(h * 0.2)
    x0, y0 = max(0, x - ex), max(0, y - ey)
    width, height = min(page_w - x + ex, w + 2 * ex), min(page_h - y + ey, h + 2 * ey)
    if width <= 0 or height <= 0:
        return float(x), float(y), float(w), float(h)
    # beyond the page counts as dark, as an unset pixel is black
    part = np.zeros((height, width))
    seen = gray[y0:y0 + height, x0:x0 + width]
    part[:seen.shape[0], :seen.shape[1]] = seen
    dark = part < 200
    dense = lambda d: np.nonzero(d > 0.1)[0]
    r, c = dense(dark.mean(1)), dense(dark.mean(0))
    top, bottom = (int(r[0]), int(r[-1])) if len(r) else (0, height - 1)
    left, right = (int(c[0]), int(c[-1])) if len(c) else (0, width - 1)
    span = max(right - left, 1)
    full = (dark[:, left:right].sum(1) / span > 0.1) if right > left else np.zeros(height, bool)
    main = bottom - top
    up = down = 0

    def far(share: float, stop_at_gap: bool) -> tuple[int, int]:
        reach = int(main * share)
        a = full[max(0, top - reach):top][::-1]
        b = full[bottom + 1:min(height, bottom + reach)]
        return tuple(_furthest(v, stop_at_gap) for v in (a, b))

    if has_scripts:
        a, b = far(0.5, True)
        up, down = max(up, a), max(down, b)
    if has_fraction:
        mid, reach = (top + bottom) // 2, (bottom - top) // 3
        line = (part[:, left:right] < 150).sum(1) / span > 0.8
        at = [v for v in range(max(0, mid - reach), min(height, mid + reach)) if line[v]]
        if at:
            above = np.nonzero(full[max(0, top - 20):at[0]])[0]
            below = np.nonzero(full[at[0] + 1:min(height, bottom + 20)])[0]
            if len(above):
                up = max(up, top - (max(0, top - 20) + int(above[0])))
            if len(below):
                down = max(down, at[0] + 1 + int(below[-1]) - bottom)
    if has_large:
        a, b = far(0.3, False)
        up, down = max(up, a), max(down, b)
    top, bottom = max(0, top - up), min(height - 1, bottom + down)
    return float(x0 + left - 2), float(y0 + top - 2), float(right - left + 4), float(bottom - top + 4)


def _furthest(full: np.ndarray, stop_at_gap: bool) -> int:
    """Distance of the furthest full row; optionally only within the first run of full rows."""
    at = np.nonzero(full)[0]
    if not len(at):
        return 0
    if stop_at_gap:
        breaks = np.nonzero(np.diff(at) > 1)[0]
        at = at[:breaks[0] + 1] if len(breaks) else at
    return int(at[-1]) + 1


# ---------------------------------------------------------------- R10
def row_profile(gray: np.ndarray, max_side: int | None = None, dark: float = 200.0) -> dict:
    """Ink count, first and last ink column (-1 for none) of the rows, or of sampled rows where ``max_side`` is given."""
    h, w = gray.shape
    scale = min(1.0, max_side / max(w, h)) if max_side else 1.0
    sw, sh = int(w * scale), int(h * scale)
    ys, xs = (np.arange(sh) / scale).astype(int), (np.arange(sw) / scale).astype(int)
    ink = gray[np.minimum(ys, h - 1)][:, np.minimum(xs, w - 1)] < dark
    some = ink.any(1)
    return {"row": np.arange(sh), "n": ink.sum(1), "lo": np.where(some, ink.argmax(1), -1),
            "hi": np.where(some, sw - 1 - ink[:, ::-1].argmax(1), -1), "scaled_w": sw, "scaled_h": sh, "scale": scale,
            "img_w": w, "img_h": h}


def row_segments(p: dict, min_blank: int = 10, min_w: int = 20, min_h: int = 10) -> list[tuple[int, int, int, int, float]]:
    """(x, y, w, h, confidence) between blank runs of rows of one `row_profile`, by the rules of `jobs.row_segments`."""
    n, scale = p["n"], p["scale"]
    if not len(n):
        return []
    blank_h = int(np.floor(min_blank * scale))
    full = np.flatnonzero(n >= p["scaled_w"] * 0.01)
    start = np.concatenate([[0], full + 1])[:len(full)]
    gap = (full - start >= blank_h) & (full > start)
    ends = np.concatenate([[0], (start[gap] + full[gap]) // 2, [len(n)]])
    out = []
    for first, last in zip(ends[:-1], ends[1:]):
        inked = np.flatnonzero(n[first:last] > 0) + first
        if last - first <= blank_h or not len(inked):
            continue
        x0, y0 = int(p["lo"][inked].min()), int(inked[0])
        w, h = int(p["hi"][inked].max()) - x0, int(inked[-1]) - y0
        if w > 0 and h > 0 and w > min_w * scale and h > min_h * scale:
            confidence = min(1.0, max(0.3, w * h / (p["scaled_w"] * p["scaled_h"] * 0.1)))
            out.append((*(int(np.floor(v / scale)) for v in (x0, y0, w, h)), confidence))
    return out or [(0, 0, p["img_w"], p["img_h"], 0.8)]


# ---------------------------------------------------------------- R12
def on_white(gray: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """What is seen of an image with opacities 0..255 that lies on white."""
    return 255 - (255 - gray) * (alpha / 255)


def enlarge(gray: np.ndarray, factor: float) -> np.ndarray:
    """Image ``factor`` times as large, linear between pixels.  Bytes are weighed exactly in integers and rounded to bytes."""
    h, w = gray.shape
    nh, nw = (max(1, int(round_half_up(n * factor))) for n in (h, w))
    if (nh, nw) == (h, w):
        return gray
    if gray.dtype != np.uint8 or nh < h or nw < w:
        return resize(gray, nw, nh)
    (i, t, d), (j, u, e) = _linear_parts(h, nh), _linear_parts(w, nw)
    kind = next(k for k in (np.uint16, np.uint32, np.uint64) if 256 * d * e <= np.iinfo(k).max)
    wide = gray.astype(kind)
    wide = wide[:, j] * (e - u).astype(kind) + wide[:, np.minimum(j + 1, w - 1)] * u.astype(kind)
    t = t[:, None]
    total = wide[i] * (d - t).astype(kind) + wide[np.minimum(i + 1, h - 1)] * t.astype(kind)
    total += kind(d * e // 2)
    return (total // kind(d * e)).astype(np.uint8)


def _linear_parts(n: int, m: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For m places over n pixels: the pixel at or before a place and the share of the next one, in parts of the last number."""
    at = np.clip((2 * np.arange(m) + 1) * n - m, 0, 2 * m * (n - 1))
    part = int(np.gcd(np.gcd.reduce(at), 2 * m))
    at, unit = at // part, 2 * m // part
    return at // unit, at % unit, unit


def prepare_crop(gray: np.ndarray, local: bool, min_side: int = 320, max_side: int = 1024, upscale: float = 1.5) -> np.ndarray:
    """Contrast, median and sharpening; enlarged before for a remote recogniser; for a local model scaled, padded with white
    and made black and white after."""
    out = sharpen(median3(equalize(gray if local else enlarge(gray, upscale))))
    if not local:
        return out
    h, w = out.shape
    scale = min_side / max(1, min(h, w)) if min(h, w) < min_side else 1.0
    if max(h, w) * scale > max_side:
        scale = max_side / max(1, max(h, w))
    nh, nw = max(1, int(round_half_up(h * scale))), max(1, int(round_half_up(w * scale)))
    if scale < 1:
        out = resize(out, nw, nh)
    else:  # growing repeats pixels
        out = out[np.minimum((np.arange(nh) * h) // nh, h - 1)][:, np.minimum((np.arange(nw) * w) // nw, w - 1)]
    pad = int(np.clip(round_half_up(min(nh, nw) * 0.12), 16, 64))
    out = np.pad(out, pad, constant_values=255.0)
    return np.where(round_half_up(out) < otsu(out), 0.0, 255.0)
