"""Small helpers over plane polygons, for use inside tasks: convex parts of a ring, cutting convex pieces by lines, areas."""

from __future__ import annotations

Point = tuple[float, float]
Ring = list[Point]


def area(ring: Ring) -> float:
    """Signed, positive counter-clockwise, with points taken from the first so that large coordinates keep their digits."""
    if len(ring) < 3:
        return 0.0
    x0, y0 = ring[0]
    return sum((ax - x0) * (by - y0) - (bx - x0) * (ay - y0) for (ax, ay), (bx, by) in zip(ring[1:], ring[2:], strict=False)) / 2


def side(a: Point, b: Point, p: Point) -> float:
    """Positive left of the line from a to b."""
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def cut(ring: Ring, a: Point, b: Point) -> tuple[Ring, Ring]:
    """What of a convex ring lies left and right of the line from a to b."""
    left, right, away = [], [], [side(a, b, p) for p in ring]
    for i, (p, d) in enumerate(zip(ring, away, strict=True)):
        q, e = ring[(i + 1) % len(ring)], away[(i + 1) % len(ring)]
        if d >= 0:
            left.append(p)
        if d <= 0:
            right.append(p)
        if d * e < 0:
            t = d / (d - e)
            # along an axis a cut is exact, so boxes stay boxes
            at = (a[0] if a[0] == b[0] else p[0] + (q[0] - p[0]) * t, a[1] if a[1] == b[1] else p[1] + (q[1] - p[1]) * t)
            left.append(at)
            right.append(at)
    return left, right


def parted(ring: Ring, other: Ring) -> tuple[Ring, list[Ring]]:
    """What a convex ring shares with another (counter-clockwise), and convex pieces of the rest."""
    rest = []
    for a, b in zip(other, other[1:] + other[:1], strict=True):
        ring, out = cut(ring, a, b)
        if len(out) > 2 and abs(area(out)) > 0:
            rest.append(out)
        if len(ring) < 3:
            return [], rest
    return ring, rest


def convex_parts(ring: Ring) -> list[Ring]:
    """A simple polygon, closed or not, of either turn, as disjoint convex pieces: itself, or triangles by cutting ears; repeated points fall out."""
    ring = [p for i, p in enumerate(ring) if p != ring[i - 1]] if len(ring) > 1 else []
    if len(ring) < 3:
        return []
    if area(ring) < 0:
        ring = ring[::-1]
    out, turns = [], [side(ring[i - 2], ring[i - 1], p) for i, p in enumerate(ring)]
    if area(ring) > 0 and min(turns) >= 0 and _once_around(ring):
        return [ring]
    ring = list(ring)
    while len(ring) > 3:
        for i in range(len(ring)):
            a, b, c = ring[i - 1], ring[i], ring[(i + 1) % len(ring)]
            turn = side(a, b, c)
            inside = turn > 0 and any(p not in (a, b, c) and side(a, b, p) >= 0 and side(b, c, p) >= 0 and side(c, a, p) >= 0 for p in ring)
            if turn > 0 and not inside:
                out.append([a, b, c])
            elif turn != 0:
                continue
            del ring[i]
            break
        else:  # crosses itself: what is left is taken as it turns
            break
    if len(ring) == 3 and side(*ring) > 0:
        out.append(ring)
    return out


def _once_around(ring: Ring) -> bool:
    """Whether a ring that only turns left goes around once: its edges turn from rising to falling x and back one time."""
    steps = [d for a, b in zip(ring, ring[1:] + ring[:1], strict=True) if (d := b[0] - a[0])]
    return sum((a > 0) != (b > 0) for a, b in zip(steps, steps[1:] + steps[:1], strict=True)) <= 2


def bounds(ring: Ring) -> tuple[float, float, float, float]:
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    return min(xs), min(ys), max(xs), max(ys)


def meet(a: tuple, b: tuple) -> bool:
    return a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]


def shared(pieces: list[Ring], boxes: list[tuple], parts: list[Ring]) -> float:
    """The area that disjoint convex pieces (with their bounds) have in common with others."""
    total = 0.0
    for t in parts:
        box = bounds(t)
        total += sum(abs(area(parted(p, t)[0])) for p, b in zip(pieces, boxes, strict=True) if meet(b, box))
    return total


def without(pieces: list[Ring], parts: list[Ring]) -> list[Ring]:
    """Disjoint convex pieces less others."""
    for t in parts:
        box, left = bounds(t), []
        for p in pieces:
            left += parted(p, t)[1] if meet(bounds(p), box) else [p]
        pieces = left
    return pieces
