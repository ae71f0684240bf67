"""Exact geometry as SQL expressions.

Every function takes SQL expressions (column names, mostly) and returns one, for
``F.expr`` or ``selectExpr``.

A geometry is ``rings ARRAY<ARRAY<STRUCT<x, y>>>``: polygons hold closed rings
(first vertex repeated at the end), lines open ones, points a ring of one
vertex.  Inside is even-odd over all rings, so holes and separate parts need no
special case.  All tests compare signs of cross products and never divide, so
they are exact whenever the coordinates are.
"""

from __future__ import annotations

RING_TYPE = "array<struct<x:double,y:double>>"
RINGS_TYPE = f"array<{RING_TYPE}>"
EXTENT = ("xmin", "ymin", "xmax", "ymax")


def point(x: str, y: str) -> str:
    return f"named_struct('x', double({x}), 'y', double({y}))"


def ring(*xy: tuple[str, str]) -> str:
    """Closed ring through the given vertices."""
    return f"array({', '.join(point(x, y) for x, y in (*xy, xy[0]))})"


def box_ring(xmin: str, ymin: str, xmax: str, ymax: str) -> str:
    return ring((xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax))


def envelope_side(rings: str, side: str) -> str:
    """One of xmin, ymin, xmax, ymax over all vertices."""
    return f"array_{side[1:]}(transform(flatten({rings}), p -> p.{side[0]}))"


def envelope(rings: str) -> str:
    """Bounding box of all vertices, as STRUCT<xmin, ymin, xmax, ymax>."""
    return f"named_struct({', '.join(f'{s!r}, {envelope_side(rings, s)}' for s in EXTENT)})"


def vertex_count(rings: str) -> str:
    """Stored vertices, a ring's closing vertex included."""
    return f"bigint(aggregate({rings}, 0, (n, r) -> n + size(r)))"


def _steps(r: str, step: str) -> str:
    """Apply ``step`` to each pair (p, q) of consecutive vertices of ring r."""
    return f"zip_with(slice({r}, 1, size({r}) - 1), slice({r}, 2, size({r}) - 1), (p, q) -> {step})"


def edges(rings: str) -> str:
    """ARRAY<STRUCT<x1, y1, x2, y2>>: consecutive vertices of every ring."""
    edge = "named_struct('x1', p.x, 'y1', p.y, 'x2', q.x, 'y2', q.y)"
    return f"flatten(transform(filter({rings}, r -> size(r) > 1), r -> {_steps('r', edge)}))"


def _side(x1: str, y1: str, x2: str, y2: str, px: str, py: str) -> str:
    """Positive, zero or negative: on which side of the line the point lies."""
    return f"(({x2} - {x1}) * ({py} - {y1}) - ({px} - {x1}) * ({y2} - {y1}))"


def edge_meets_box(x1: str, y1: str, x2: str, y2: str, xmin: str, ymin: str, xmax: str, ymax: str) -> str:
    """Segment and closed rectangle share a point: their boxes overlap and the four
    corners are not all strictly on one side of the segment's line."""
    corners = ", ".join(_side(x1, y1, x2, y2, cx, cy) for cx in (xmin, xmax) for cy in (ymin, ymax))
    return (f"(least({x1}, {x2}) <= {xmax} AND greatest({x1}, {x2}) >= {xmin}"
            f" AND least({y1}, {y2}) <= {ymax} AND greatest({y1}, {y2}) >= {ymin}"
            f" AND least({corners}) <= 0 AND greatest({corners}) >= 0)")


def ray_crosses(px: str, py: str, x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2") -> str:
    """The ray from (px, py) towards +x crosses the edge; an odd count means inside."""
    side = _side(x1, y1, x2, y2, px, py)
    return f"((({y1} > {py}) <> ({y2} > {py})) AND if({y2} > {y1}, {side} > 0, {side} < 0))"


def segments_meet(a: str, b: str) -> str:
    """Two closed segments (columns with prefixes a and b) share a point: their boxes
    overlap and neither lies strictly on one side of the other's line."""
    return edges_meet(*[[p + c for c in ("x1", "y1", "x2", "y2")] for p in (a, b)])


def edges_meet(a: list[str], b: list[str], rightward: bool = False) -> str:
    """segments_meet() of two segments given by x1, y1, x2, y2; with ``rightward`` both have x1 <= x2."""
    def apart(line: list[str], other: list[str]) -> str:
        x1, y1, x2, y2 = other
        return f"signum({_side(*line, x1, y1)}) * signum({_side(*line, x2, y2)})"

    ax1, ay1, ax2, ay2 = a
    bx1, by1, bx2, by2 = b
    level = (f"{ax1} <= {bx2} AND {ax2} >= {bx1}" if rightward else
             f"least({ax1}, {ax2}) <= greatest({bx1}, {bx2}) AND greatest({ax1}, {ax2}) >= least({bx1}, {bx2})")
    return (f"({level} AND least({ay1}, {ay2}) <= greatest({by1}, {by2}) AND greatest({ay1}, {ay2}) >= least({by1}, {by2})"
            f" AND {apart(a, b)} <= 0 AND {apart(b, a)} <= 0)")


def ring_area(r: str) -> str:
    """Unsigned area of one closed ring."""
    return f"(abs(aggregate({_steps(r, 'p.x * q.y - q.x * p.y')}, 0D, (s, v) -> s + v)) / 2)"


def ring_holds(outer: str, inner: str) -> str:
    """Some vertex or middle of an edge of ``inner`` lies strictly inside ``outer``: for rings that do not
    cross, the whole ring does.  Stops at the first such point; envelopes are compared first."""
    sides = [f"array_{f}(transform({r}, p -> p.{a}))" for a in "xy" for f in ("min", "max") for r in (outer, inner)]
    within = (f"{sides[0]} <= {sides[1]} AND {sides[2]} >= {sides[3]} AND {sides[4]} <= {sides[5]} AND {sides[6]} >= {sides[7]}")
    middle = point("(p.x + q.x) / 2", "(p.y + q.y) / 2")
    probes = f"concat({inner}, {_steps(inner, middle)})"
    side = _side("e.x1", "e.y1", "e.x2", "e.y2", "pt.x", "pt.y")
    on_edge = (f"({side} = 0 AND pt.x BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2)"
               f" AND pt.y BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2))")
    around = edges(f"array({outer})")
    crossings = f"size(filter({around}, e -> {ray_crosses('pt.x', 'pt.y', 'e.x1', 'e.y1', 'e.x2', 'e.y2')}))"
    return f"({within} AND exists({probes}, pt -> {crossings} % 2 = 1 AND NOT exists({around}, e -> {on_edge})))"


def rings_around(rings: str) -> str:
    """For each ring, the indexes of the rings that hold it.  Of two rings that would hold each other
    (they cross, so the polygon is not valid) the larger is the outer one, or the earlier."""
    larger = f"({ring_area('host')} > {ring_area('guest')} OR ({ring_area('host')} = {ring_area('guest')} AND j < i))"
    return (f"transform({rings}, (guest, i) -> filter(transform({rings}, (host, j) -> "
            f"if(j <> i AND {ring_holds('host', 'guest')} AND {larger}, j, -1)), j -> j >= 0))")


def hole_shells(around: str) -> str:
    """From rings_around: the shell of each ring that is a hole, -1 for rings that are shells themselves.

    A ring within an odd number of others is a hole of the one a level up; without such a ring it counts as a shell."""
    up = f"filter(a, j -> size(get({around}, j)) = size(a) - 1)"
    return f"transform({around}, a -> if(size(a) % 2 = 1, coalesce(get({up}, 0), -1), -1))"


def nested_parts(rings: str, shells: str) -> str:
    """ARRAY of polygons, each its shell and then its holes; every ring is in one of them."""
    holes = f"transform(filter(transform({shells}, (s, k) -> if(s = i, k, -1)), k -> k >= 0), k -> get({rings}, k))"
    part = f"if(s < 0, concat(array(get({rings}, i)), {holes}), NULL)"
    return f"filter(transform({shells}, (s, i) -> {part}), g -> g IS NOT NULL)"


def clip_half_plane(rings: str, axis: str, bound: str, keep_above: bool) -> str:
    """Cut closed rings by a line parallel to an axis and keep one side.

    Rings stay closed; a ring left without area disappears.
    """
    other = "y" if axis == "x" else "x"
    test = ">=" if keep_above else "<="
    at = f"p.{other} + ({bound} - p.{axis}) * (q.{other} - p.{other}) / (q.{axis} - p.{axis})"
    meet = point(bound, at) if axis == "x" else point(at, bound)
    none = f"cast(array() AS {RING_TYPE})"
    step = (f"concat(if(p.{axis} {test} {bound}, array(p), {none}),"
            f" if((p.{axis} {test} {bound}) <> (q.{axis} {test} {bound}), array({meet}), {none}))")
    cut = f"transform(filter({rings}, r -> size(r) > 1), r -> flatten({_steps('r', step)}))"
    closed = f"transform(filter({cut}, r -> size(r) > 2), r -> concat(r, slice(r, 1, 1)))"
    return f"filter({closed}, r -> {ring_area('r')} > 0)"


def is_closed(r: str) -> str:
    """The path is a polygon's ring: it ends where it began and has an inside."""
    return f"(size({r}) > 3 AND {r}[0] = element_at({r}, -1))"


def _edge_span(axis: str, low: str, high: str) -> tuple[str, str]:
    """Where an edge from p to q, as a share of its length, enters and leaves low <= axis <= high; it misses if it leaves first."""
    step = f"(q.{axis} - p.{axis})"
    near, far = (f"if({step} > 0, {{}}, {{}}) - p.{axis}".format(*b) for b in ((low, high), (high, low)))
    flat = f"if(p.{axis} BETWEEN {low} AND {high}, {{}}, {{}})"
    return (f"if({step} = 0, {flat.format('0D', '2D')}, greatest(0D, ({near}) / {step}))",
            f"if({step} = 0, {flat.format('1D', '-1D')}, least(1D, ({far}) / {step}))")


def clip_path_to_band(rings: str, axis: str, low: str, high: str) -> str:
    """Part of open paths with low <= axis <= high: pieces of paths, and points that lie there.

    A path that leaves and comes back becomes several; what only touches the band has no length and disappears.
    """
    other = "y" if axis == "x" else "x"
    enter, leave = _edge_span(axis, low, high)

    def at(share: str) -> str:
        on_axis = f"greatest({low}, least({high}, p.{axis} + {share} * (q.{axis} - p.{axis})))"
        across = f"p.{other} + {share} * (q.{other} - p.{other})"
        cut = point(on_axis, across) if axis == "x" else point(across, on_axis)
        return f"CASE WHEN {share} <= 0 THEN p WHEN {share} >= 1 THEN q ELSE {cut} END"

    none = f"cast(array() AS {RINGS_TYPE})"
    span = f"named_struct('p', p, 'q', q, 'a', {enter}, 'b', {leave})"
    spans = f"filter({_steps('r', span)}, s -> s.a < s.b)"
    pieces = (f"filter(transform({spans}, s -> transform(array(s), (s, i) -> transform(array(s.p), p -> transform(array(s.q), q -> "
              f"named_struct('a', {at('s.a')}, 'b', {at('s.b')}))[0])[0])[0]), e -> e.a <> e.b)")
    last = "element_at(acc, -1)"
    joined = (f"if(size(acc) > 0 AND element_at({last}, -1) = e.a, "
              f"concat(slice(acc, 1, size(acc) - 1), array(concat({last}, array(e.b)))), concat(acc, array(array(e.a, e.b))))")
    paths = f"aggregate({pieces}, {none}, (acc, e) -> {joined})"
    points = f"if(r[0].{axis} BETWEEN {low} AND {high}, array(r), {none})"
    return f"flatten(transform(filter({rings}, r -> size(r) > 0), r -> if(size(r) = 1, {points}, {paths})))"


def clip_to_band(rings: str, axis: str, low: str, high: str) -> str:
    """Part of the rings with low <= axis <= high; rings stay closed, open paths open."""
    closed = f"filter({rings}, r -> {is_closed('r')})"
    cut = clip_half_plane(clip_half_plane(closed, axis, low, True), axis, high, False)
    return f"concat({cut}, {clip_path_to_band(f'filter({rings}, r -> NOT {is_closed("r")})', axis, low, high)})"


def path_length(rings: str) -> str:
    """Length of all edges."""
    edge = "sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y))"
    return f"aggregate(flatten(transform(filter({rings}, r -> size(r) > 1), r -> {_steps('r', edge)})), 0D, (s, v) -> s + v)"
