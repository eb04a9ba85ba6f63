"""Searching small state graphs: one level a row, searched where the row lies."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Hashable, Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = {"up": (0, -1), "down": (0, 1), "left": (-1, 0), "right": (1, 0)}


def shortest(
    width: int, height: int, walls: set[tuple[int, int]], start: tuple[int, int], goals: set[tuple[int, int]]
) -> tuple[int | None, list[str]]:
    """Least number of moves to a goal and every first move that some shortest way begins with; (None, []) if none."""
    if start in goals:
        return 0, []
    ways: dict[tuple[int, int], tuple[int, set[str]]] = {start: (0, set())}
    queue, best = deque([start]), None
    firsts: set[str] = set()
    while queue:
        at = queue.popleft()
        d, via = ways[at]
        if best is not None and d >= best:
            break
        for name, (dx, dy) in STEPS.items():
            to = (at[0] + dx, at[1] + dy)
            if not (0 <= to[0] < width and 0 <= to[1] < height) or to in walls:
                continue
            new = via or {name}
            if to not in ways:
                ways[to] = (d + 1, set(new))
                queue.append(to)
            elif ways[to][0] == d + 1:
                ways[to][1].update(new)
            if to in goals:
                best = d + 1
    if best is not None:
        for g in goals:
            if g in ways and ways[g][0] == best:
                firsts |= ways[g][1]
    return best, sorted(firsts)


def parse(level: str) -> tuple[int, int, set, tuple[int, int] | None, set, set]:
    """Width, height, walls, player, boxes and goals of a level text; raises ValueError for a malformed one."""
    rows = [r for r in level.split("\n") if r]
    if not rows or len({len(r) for r in rows}) != 1:
        raise ValueError("not rectangular")
    walls, boxes, goals, players = set(), set(), set(), []
    for y, row in enumerate(rows):
        for x, c in enumerate(row):
            if c not in "# @$.*+":
                raise ValueError(f"unknown tile {c!r}")
            if c == "#":
                walls.add((x, y))
            if c in "$*":
                boxes.add((x, y))
            if c in ".*+":
                goals.add((x, y))
            if c in "@+":
                players.append((x, y))
    if len(players) != 1 or len(boxes) != len(goals):
        raise ValueError("one player and as many boxes as goals are needed")
    return len(rows[0]), len(rows), walls, players[0], boxes, goals


class LimitReached(RuntimeError):
    """A search looked at its limit of states without an answer."""


def pull_distances(width: int, height: int, walls: set, goals: set) -> dict[tuple[int, int], int]:
    """Least number of pushes that bring a lone box from a cell to the nearest goal; cells without a way are missing."""
    free = lambda c: 0 <= c[0] < width and 0 <= c[1] < height and c not in walls
    far = dict.fromkeys(goals, 0)
    queue = deque(goals)
    while queue:
        x, y = queue.popleft()
        for dx, dy in STEPS.values():
            box, player = (x - dx, y - dy), (x - 2 * dx, y - 2 * dy)
            if free(box) and free(player) and box not in far:
                far[box] = far[x, y] + 1
                queue.append(box)
    return far


def least_moves(
    player: tuple[int, int], boxes: frozenset, goals: frozenset, step: Callable, far: dict, limit: int, most: int | None = None
) -> tuple[int | None, int]:
    """(moves, states looked at) of a cheapest solution, of at most ``most`` moves; None if it is proved that none exists.

    A* over (player, boxes), one move a step. The estimate sums each box's pushes to its nearest goal, so it never
    exceeds the true number; a box that can reach no goal ends a branch.
    """
    start = (player, boxes)
    if any(b not in far for b in boxes):
        return None, 0
    cost, order, seen = {start: 0}, count(), 0
    heap = [(sum(far[b] for b in boxes), 0, next(order), start)]
    while heap:
        estimate, done, _, state = heapq.heappop(heap)
        if most is not None and estimate > most:
            return None, seen
        if done > cost[state]:
            continue
        if state[1] == goals:
            return done, seen
        seen += 1
        if seen > limit:
            raise LimitReached(f"no answer within {limit} states")
        for name in STEPS:
            to = step(state, name)
            if to is not None and done + 1 < cost.get(to, 1 << 60) and all(b in far for b in to[1]):
                cost[to] = done + 1
                heapq.heappush(heap, (done + 1 + sum(far[b] for b in to[1]), done + 1, next(order), to))
    return None, seen


def solve_boxes(level: str, limit: int = 2_000_000) -> tuple[int | None, list[str], int]:
    """(moves of a cheapest solution, every move that one begins with, states looked at); (None, [], n) if none exists.

    A first move belongs to a cheapest solution if what is left after it takes one move less. Raises LimitReached
    after ``limit`` states in any of the searches: that the level can't be solved is only said once it is proved.
    """
    width, height, walls, player, boxes, goals = parse(level)
    far, ends = pull_distances(width, height, walls, goals), frozenset(goals)

    def step(state: tuple, name: str) -> tuple | None:
        (x, y), bs = state
        dx, dy = STEPS[name]
        to, beyond = (x + dx, y + dy), (x + 2 * dx, y + 2 * dy)
        free = lambda c: 0 <= c[0] < width and 0 <= c[1] < height and c not in walls
        if not free(to):
            return None
        if to not in bs:
            return to, bs
        return (to, bs - {to} | {beyond}) if free(beyond) and beyond not in bs else None

    moves, seen = least_moves(player, frozenset(boxes), ends, step, far, limit)
    firsts = []
    for name in STEPS if moves else ():
        to = step((player, frozenset(boxes)), name)
        if to is not None:
            left, more = least_moves(*to, ends, step, far, limit, moves - 1)
            seen += more
            if left == moves - 1:
                firsts.append(name)
    return moves, sorted(firsts), seen


def solve_levels(levels: DataFrame, limit: int = 2_000_000, keys: tuple[str, ...] = ("level_id",)) -> DataFrame:
    """(keys, moves, firsts, states, error): each level solved in place.

    A malformed level, and one whose search reached the limit, are rows with their error; a level without a solution
    has null moves and no error.
    """
    names = [*keys, "moves", "firsts", "states", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for *k, level in b[[*keys, "level"]].itertuples(index=False, name=None):
                try:
                    out.append((*k, *solve_boxes(level, limit), None))
                except (ValueError, AttributeError, LimitReached) as e:
                    out.append((*k, None, [], 0, str(e)))
            yield pd.DataFrame(out, columns=names).astype({"moves": "Int64"})

    kinds = ", ".join(f"`{k}` {levels.schema[k].dataType.simpleString()}" for k in keys)
    return levels.select(*keys, "level").mapInPandas(run, f"{kinds}, moves long, firsts array<string>, states long, error string")


# The directions of a navigating agent, in turning order to the right.
FACING = ((1, 0), (0, 1), (-1, 0), (0, -1))
#: Moves of a navigating agent.
TURNS = ("forward", "left", "right", "toggle")


def first_moves(start: Hashable, moves: tuple[str, ...], after: Callable, limit: int) -> tuple[int | None, list[str]]:
    """Least number of moves to an end, and every move that a shortest way begins with; (None, []) if none can be reached.

    after(state, move): the state it leads to and whether that is an end, or None where the move does nothing. States
    are visited in layers of equal distance; each carries all first moves that lead to it that fast. Raises
    LimitReached beyond ``limit`` states.
    """
    layer: dict[Hashable, set[str]] = {start: set()}
    depth, seen = 0, {start}
    while layer:
        depth += 1
        following: dict[Hashable, set[str]] = {}
        won: set[str] = set()
        for state, via in layer.items():
            for move in moves:
                step = after(state, move)
                if step is None:
                    continue
                to, end = step
                if end:
                    won |= via or {move}
                elif to not in seen:
                    following.setdefault(to, set()).update(via or {move})
        if won:
            return depth, sorted(won)
        seen.update(following)
        if len(seen) > limit:
            raise LimitReached(f"no answer within {limit} states")
        layer = following
    return None, []


def turned(way: int, move: str) -> int:
    """The direction faced after turning."""
    return (way + (1 if move == "right" else 3)) % 4


def navigate(
    width: int, height: int, passable: set, goals: set, doors: dict, start: tuple[int, int], facing: int, opened: int = 0, limit: int = 200_000
) -> tuple[int | None, list[str]]:
    """Least number of moves of an agent that turns, walks and opens doors, and every move that a shortest way begins with.

    A state is the cell, the direction faced and a bit mask of open doors. ``doors`` gives each door's bit by its
    cell; a door is walked through only while it is open, and toggling changes the door ahead. (None, []) if no goal
    can be reached; (0, []) on a goal. Raises LimitReached beyond ``limit`` states.
    """

    def after(state: tuple, move: str) -> tuple | None:
        cell, way, mask = state
        if move in ("left", "right"):
            return (cell, turned(way, move), mask), False
        ahead = (cell[0] + FACING[way][0], cell[1] + FACING[way][1])
        if move == "toggle":
            return ((cell, way, mask ^ (1 << doors[ahead])), False) if ahead in doors else None
        inside = 0 <= ahead[0] < width and 0 <= ahead[1] < height
        free = mask >> doors[ahead] & 1 if ahead in doors else ahead in passable
        return ((ahead, way, mask), ahead in goals) if inside and free else None

    return (0, []) if start in goals else first_moves((start, facing, opened), TURNS, after, limit)


Thing = tuple[str, str, str]


def use_tools(
    walls: set, goals: set, things: dict[tuple[int, int], Thing], start: tuple[int, int], facing: int, mission: str,
    held: tuple[str, str] | None = None, limit: int = 200_000
) -> tuple[int | None, list[str]]:
    """``navigate`` in a world of things: also take and put them, and unlock doors with the key of their colour.

    things: (kind, colour, status) by cell: doors, which are open, closed or locked, and keys, boxes and balls. Of these
    one can be held. mission: 'reach' a goal, 'take' a box, or 'open' a door. Walls have to enclose the world.
    """

    def after(state: tuple, move: str) -> tuple | None:
        cell, way, hand, rest = state
        if move in ("left", "right"):
            return (cell, turned(way, move), hand, rest), False
        ahead = (cell[0] + FACING[way][0], cell[1] + FACING[way][1])
        thing = dict(rest).get(ahead)
        others = frozenset(t for t in rest if t[0] != ahead)
        if move == "forward":
            blocked = ahead in walls or thing is not None and thing[::2] != ("door", "open")
            return None if blocked else ((ahead, way, hand, rest), mission == "reach" and ahead in goals)
        if move == "take":
            if hand is not None or thing is None or thing[0] == "door":
                return None
            return (cell, way, thing[:2], others), mission == "take" and thing[0] == "box"
        if move == "put":
            if hand is None or thing is not None or ahead in walls or ahead in goals:
                return None
            return (cell, way, None, others | {(ahead, (*hand, ""))}), False
        if thing is None or thing[0] != "door" or thing[2] == "locked" and hand != ("key", thing[1]):
            return None
        status = "closed" if thing[2] == "open" else "open"
        return (cell, way, hand, others | {(ahead, ("door", thing[1], status))}), mission == "open" and status == "open"

    return first_moves((start, facing, held, frozenset(things.items())), (*TURNS, "take", "put"), after, limit)


def drawn_levels(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, place, level): the grids drawn in texts, in boxes of ┌─┐│└┘ lines, by their order in the text."""
    frames = F.regexp_extract_all(text, F.lit("┌─+┐\n((?:│[^│\n]*│\n)+)└─+┘"), F.lit(1))
    out = docs.where(F.col(key).isNotNull() & F.col(text).contains("┌")).select(key, F.posexplode(frames).alias("place", "frame"))
    rows = F.split(F.regexp_replace("frame", "\n$", ""), "\n")
    return out.select(key, "place", F.array_join(F.transform(rows, lambda r: F.substring(r, F.lit(2), F.length(r) - 2)), "\n").alias("level"))


def tiles(levels: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, width, height, walls, players, boxes, goals): what each level holds; width is null for ragged rows."""
    rows = F.split("level", "\n")
    widths = F.transform(rows, F.length)
    of = lambda chars: F.length("level") - F.length(F.translate("level", chars, ""))
    width = F.when(F.array_min(widths) == F.array_max(widths), F.array_min(widths))
    return levels.select(
        *keys, width.alias("width"), F.size(rows).alias("height"), of("#").alias("walls"), of("@+").alias("players"), of("$*").alias("boxes"),
        of(".*+").alias("goals")
    )


def flow(supply: dict[str, int], demand: dict[str, int], room: dict[tuple[str, str], int]) -> dict[tuple[str, str], int]:
    """A greatest flow from supplies to demands through limited pairs, by shortest augmenting ways; a few dozen nodes."""
    sent = {k: 0 for k in room}
    left, need = dict(supply), dict(demand)
    while True:
        back: dict[tuple[str, str], tuple[str, str] | None] = {("s", a): None for a in supply if left[a] > 0}
        queue, end = deque(back), None
        while queue and end is None:
            side, x = queue.popleft()
            if side == "s":
                nxt = [("d", d) for (a, d) in room if a == x and sent[a, d] < room[a, d]]
            else:
                if need[x] > 0:
                    end = (side, x)
                    break
                nxt = [("s", a) for (a, d) in room if d == x and sent[a, d] > 0]
            for v in nxt:
                if v not in back:
                    back[v] = (side, x)
                    queue.append(v)
        if end is None:
            return sent
        path = [end]
        while back[path[-1]] is not None:
            path.append(back[path[-1]])
        path.reverse()
        steps = list(zip(path, path[1:]))
        amount = min([left[path[0][1]], need[end[1]], *(room[u[1], v[1]] - sent[u[1], v[1]] if u[0] == "s" else sent[v[1], u[1]] for u, v in steps)])
        for u, v in steps:
            if u[0] == "s":
                sent[u[1], v[1]] += amount
            else:
                sent[v[1], u[1]] -= amount
        left[path[0][1]] -= amount
        need[end[1]] -= amount
