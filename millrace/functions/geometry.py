"""Rounding, coordinate systems, boxes and polygons on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def half_up(c: Column, digits: int = 0) -> Column:
    return F.round(c.cast("decimal(30,10)"), digits).cast("double")


def round_coord(c: Column) -> Column:
    """Three decimals, half to even; a text without decimals if whole."""
    r = F.bround(c, 3)
    return F.when(r == F.floor(r), F.floor(r).cast("string")).otherwise(r.cast("string"))


def js_round(c: Column) -> Column:
    return F.floor(c + 0.5)


def wrap_deg(c: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(c + 180, F.lit(360.0)) - 180


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def quantize(c: Column, extent: Column | float) -> Column:
    """Pixels to 0..1000, floor(x + 0.5)."""
    return clamp(F.floor(c * 1000 / extent + 0.5), 0, 1000).cast("long")


def pixel_to_model(c: Column, extent: Column | float) -> Column:
    """Pixels to 0..1000, half to even."""
    return clamp(F.bround(c / extent * 1000), 0, 1000).cast("long")


def model_to_pixel(c: Column, extent: Column | float) -> Column:
    """0..1000 to pixels; null outside the range."""
    return F.when(c.between(0, 1000), c / 1000.0 * extent)


def relative_bin(c: Column, size: Column | float) -> Column:
    """0..1000, clamped, to pixels below the size; unchanged for an empty size."""
    size = F.lit(size).cast("double")
    return F.when(size <= 0, c.cast("double")).otherwise(F.least(clamp(c.cast("double"), 0, 1000) / 1000 * size, size - 1))


def to_resized(c: Column, size: Column) -> Column:
    """0..1000 to pixels of a resized image, half up."""
    return half_up(c * size / 1000).cast("long")


def model_bbox(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column) -> list[Column]:
    return [v * 1000 / e for v, e in ((x1, w), (y1, h), (x2, w), (y2, h))]


def inside_image(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column) -> Column:
    return (x1 >= 0) & (y1 >= 0) & (x2 <= w) & (y2 <= h) & (x1 < x2) & (y1 < y2)


def bbox_contains(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return px.between(x1, x2) & py.between(y1, y2)


def distance_bbox(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx = F.greatest(x1 - px, F.lit(0.0), px - x2)
    dy = F.greatest(y1 - py, F.lit(0.0), py - y2)
    return F.sqrt(dx * dx + dy * dy)


def point_in_polygon(px: Column, py: Column, points: Column) -> Column:
    """Ray casting; points on an edge are inside. Fewer than three points: null."""
    n = F.size(points)
    turned = let(points, lambda p: F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1)))
    edges = let(points, lambda p: F.zip_with(p, turned, lambda a, b: F.struct(a.alias("a"), b.alias("b"))))

    def on(e: Column) -> Column:
        cross = (e.b.x - e.a.x) * (py - e.a.y) - (e.b.y - e.a.y) * (px - e.a.x)
        return (F.abs(cross) < 1e-9) & px.between(F.least(e.a.x, e.b.x), F.greatest(e.a.x, e.b.x)) & py.between(F.least(e.a.y, e.b.y), F.greatest(e.a.y, e.b.y))

    def crosses(e: Column) -> Column:
        spans = (e.a.y > py) != (e.b.y > py)
        at = e.a.x + (py - e.a.y) * (e.b.x - e.a.x) / F.when(spans, e.b.y - e.a.y).otherwise(1.0)
        return F.when(spans & (px < at), 1).otherwise(0)

    def judge(e: Column) -> Column:
        return F.exists(e, on) | (F.aggregate(F.transform(e, crosses), F.lit(0), lambda s, x: s + x) % 2 == 1)

    return F.when(n >= 3, let(edges, judge))


def score(x: Column, y: Column, w: Column, h: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """correct, wrong or wrong_format (no coordinate, or one outside 0..1000), for a point in 0..1000 of a w x h image."""
    bad = x.isNull() | y.isNull() | ~x.between(0, 1000) | ~y.between(0, 1000)
    return F.when(bad, "wrong_format").when(bbox_contains(x * w / 1000.0, y * h / 1000.0, x1, y1, x2, y2), "correct").otherwise("wrong")


def score_sequence(actions: Column, w: Column, h: Column, x1: Column, y1: Column, x2: Column, y2: Column, most_clicks: int = 3) -> Column:
    """Outcome of a sequence of (action, coordinate, status): correct, wrong, wrong_format or wrong_action.

    Clicks, then one final terminate(success); the last click is scored. The
    first broken rule in order decides.
    """
    n = F.size(actions)
    is_click = lambda a: a.action == "left_click"
    clicks = F.filter(actions, is_click)

    def issue(a: Column, i: Column) -> Column:
        so_far = F.size(F.filter(F.slice(actions, 1, i + 1), is_click))
        fits = (F.size(a.coordinate) == 2) & F.forall(a.coordinate, lambda v: v.isNotNull() & v.between(0, 1000))
        click = F.when(a.status.isNotNull() | ~F.coalesce(fits, F.lit(False)), "wrong_format").when(so_far > most_clicks, "wrong_action")
        end = F.when(a.coordinate.isNotNull() | ~F.coalesce(a.status.isin("success", "failure"), F.lit(False)), "wrong_format").when(i != n - 1, "wrong_action")
        return F.when(is_click(a), click).when(a.action == "terminate", end).otherwise("wrong_format")

    issues = F.array_compact(F.transform(actions, issue))
    last, point = F.try_element_at(actions, F.lit(-1)), F.try_element_at(clicks, F.lit(-1)).coordinate
    done = F.when(last.action != "terminate", "wrong_format").when((last.status != "success") | (F.size(clicks) == 0), "wrong_action")
    return F.when(n == 0, "wrong_format").otherwise(F.coalesce(F.get(issues, 0), done, score(F.get(point, 0), F.get(point, 1), w, h, x1, y1, x2, y2)))


def score_press(actions: Column, sw: Column, sh: Column, w: Column, h: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A struct (hit, released, errors, success) of moves, one press and one release.

    Of (kind, x, y) actions the last valid move before the press counts, scaled
    from an sw x sh image to the w x h one that the box is in; the press must be
    released later, and any breach of the protocol is an error.
    """
    nothing = F.lit(None).cast("double")
    start = F.struct(nothing.alias("mx"), nothing.alias("my"), nothing.alias("sx"), nothing.alias("sy"), F.lit(False).alias("pressed"), F.lit(False).alias("released"), F.lit(False).alias("down"), F.lit(0).alias("errors"))

    def step(s: Column, a: Column) -> Column:
        move, press, release = a.kind == "mouse_move", a.kind == "mouse_down", a.kind == "mouse_up"
        valid = move & F.coalesce(a.x.between(0, sw) & a.y.between(0, sh), F.lit(False))
        first = press & ~s.down & ~s.pressed
        freed = release & s.down & ~s.released
        wrong = (move & ~valid) | (press & s.down) | (first & s.mx.isNull()) | (release & (~s.down | s.released)) | ~(move | press | release)
        return F.struct(
            F.when(valid, a.x).otherwise(s.mx).alias("mx"), F.when(valid, a.y).otherwise(s.my).alias("my"), F.when(first, s.mx).otherwise(s.sx).alias("sx"), F.when(first, s.my).otherwise(s.sy).alias("sy"),
            (s.pressed | first).alias("pressed"), (s.released | freed).alias("released"), ((s.down | first) & ~freed).alias("down"), (s.errors + wrong.cast("int")).alias("errors"),
        )

    def end(s: Column) -> Column:
        hit = F.coalesce(bbox_contains(s.sx * w / sw, s.sy * h / sh, x1, y1, x2, y2), F.lit(False))
        return F.struct(hit.alias("hit"), s.released.alias("released"), s.errors.alias("errors"), (hit & s.released & (s.errors == 0)).alias("success"))

    return F.aggregate(actions, start, step, end)


def path_valid(sx: Column, sy: Column, tx: Column, ty: Column, points: Column, x1: Column, y1: Column, x2: Column, y2: Column, w: float, h: float, step: float = 12.0) -> Column:
    """A path of points to a target in a box: on the canvas, no point twice, steps of at least
    ``step``, always nearer to the target, never farther from the box, and inside it only at the end."""
    dist = lambda ax, ay, bx, by: F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))
    box = lambda x, y: distance_bbox(x, y, x1, y1, x2, y2)
    n = F.size(points)
    all_ = F.concat(F.array(F.struct(sx.cast("double").alias("x"), sy.cast("double").alias("y"))), points)

    def good(p: Column, i: Column) -> Column:
        q = F.get(all_, i)
        nearer = dist(p.x, p.y, tx, ty) < dist(q.x, q.y, tx, ty)
        calm = box(p.x, p.y) <= box(q.x, q.y) + 1e-9
        early = (i < n - 1) & bbox_contains(p.x, p.y, x1, y1, x2, y2)
        return p.x.between(0, w) & p.y.between(0, h) & (dist(p.x, p.y, q.x, q.y) >= step) & nearer & calm & ~early

    last = F.try_element_at(points, F.lit(-1))
    ends = (last.x == tx) & (last.y == ty) & bbox_contains(tx, ty, x1, y1, x2, y2)
    return F.coalesce((n > 0) & ends & (F.size(F.array_distinct(all_)) == n + 1) & F.forall(F.transform(points, good), lambda ok: ok), F.lit(False))


def bucket(value: Column, bounds: list[tuple[float, str]], last: str) -> Column:
    """The name of the first bound that the value is below."""
    out = F.lit(last)
    for bound, name in reversed(bounds):
        out = F.when(value < bound, name).otherwise(out)
    return out


# Names and bounds of the buckets.
SIZES = ([(640 * 480, "small"), (1280 * 720, "medium"), (1920 * 1080, "large")], "xlarge")
AREAS = ([(0.001, "tiny"), (0.01, "small"), (0.05, "medium")], "large")


def aspect_bucket(w: Column, h: Column) -> Column:
    r = w / h
    return F.when(r < 0.8, "portrait").when(r <= 1.25, "square").when(r <= 1.8, "landscape").otherwise("wide")


def size_bucket(w: Column, h: Column) -> Column:
    return bucket(w * h, *SIZES)


def area_bucket(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column) -> Column:
    return bucket((x2 - x1) * (y2 - y1) / (w * h), *AREAS)


def projection_alpha(ux: Column, uy: Column, ex: Column, ey: Column) -> Column:
    """Share of the error vector e that the movement u covers: u.e / e.e, null for no error."""
    return F.try_divide(ux * ex + uy * ey, ex * ex + ey * ey)


def smart_resize(w: Column, h: Column, factor: int, least: int, most: int, rounds: int = 256) -> tuple[Column, Column]:
    """Sides as multiples of a factor with an area in [least, most]; null beyond an aspect of 200.

    Rounded if that fits; else both scaled by one ratio, then a side a step
    shorter while the area is too large (the longer one) or a step longer while
    it is too small (the one that was scaled less).
    """
    near = lambda v: F.greatest(F.lit(float(factor)), F.bround(v / factor) * factor)
    low = lambda v: F.greatest(F.lit(float(factor)), F.floor(v / factor) * factor)
    high = lambda v: F.greatest(F.lit(float(factor)), F.ceil(v / factor) * factor)
    area, rounded = w * h, near(w) * near(h)
    down, up = F.sqrt(area / most), F.sqrt(F.lit(float(least)) / area)
    size = lambda v: F.when(rounded > most, low(v / down)).when(rounded < least, high(v * up)).otherwise(near(v)).cast("double")
    step = float(factor)

    def shrink(s: Column, _: Column) -> Column:
        over = s.w * s.h > most
        wide = over & (s.w >= s.h) & (s.w > step)
        tall = over & ~wide & (s.h > step)
        return F.struct((s.w - F.when(wide, step).otherwise(0.0)).alias("w"), (s.h - F.when(tall, step).otherwise(0.0)).alias("h"))

    def grow(s: Column, _: Column) -> Column:
        under = s.w * s.h < least
        wide = under & (s.w / w <= s.h / h)
        return F.struct((s.w + F.when(wide, step).otherwise(0.0)).alias("w"), (s.h + F.when(under & ~wide, step).otherwise(0.0)).alias("h"))

    turns = F.sequence(F.lit(1), F.lit(rounds))
    pair = F.struct(size(w).alias("w"), size(h).alias("h"))
    fits = (rounded <= most) & (rounded >= least)
    pair = F.when(fits, pair).otherwise(F.aggregate(turns, F.aggregate(turns, pair, shrink), grow))
    pair = F.when(F.greatest(w, h) / F.least(w, h) <= 200, pair)
    return pair.w.cast("long"), pair.h.cast("long")


def visual_tokens(w: Column, h: Column, factor: int) -> Column:
    return F.floor(w / factor) * F.floor(h / factor)


def rect_overlap(ax: Column, ay: Column, bx: Column, by: Column, size: float) -> Column:
    return (F.abs(ax - bx) < size) & (F.abs(ay - by) < size)


def overshoots(points: Column, sx: Column, sy: Column, tx: Column, ty: Column, over: float = 1.02, near: float = 0.02) -> Column:
    """Some point before the last passes the target on its segment, and the last one returns to it."""
    ex, ey = tx - sx, ty - sy
    norm = ex * ex + ey * ey
    share = F.transform(points, lambda p: F.try_divide((p.x - sx) * ex + (p.y - sy) * ey, norm))
    before = F.slice(share, 1, F.greatest(F.size(share) - 1, F.lit(0)))
    return F.coalesce((F.size(points) >= 2) & (norm > 1e-6) & F.exists(before, lambda s: s > over) & (F.abs(F.element_at(share, -1) - 1) <= near), F.lit(False))
