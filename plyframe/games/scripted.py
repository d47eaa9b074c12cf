"""Boards whose moves are sequences, links or walls: plain functions of one state, run over
Arrow batches. A state is one integer below 2^63."""

from __future__ import annotations

from itertools import product

from plyframe.games.core import Game, scripted

_EIGHT = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
_FOUR = [(0, -1), (1, 0), (0, 1), (-1, 0)]


def _cells(mask: int) -> list[int]:
    out = []
    while mask:
        out.append((mask & -mask).bit_length() - 1)
        mask &= mask - 1
    return out


def fanorona(w: int, h: int, setup: str | None = None) -> Game:
    """Captures by approach or withdrawal are forced and may go on with the same stone, not
    in the same direction twice running, nor to a point it has been on. No stones or no
    move loses. States are (white, black, turn); setup is rows from the top, black first."""
    n = w * h
    lines = {}
    for c in range(n):
        x, y = c % w, c // w
        for dx, dy in _EIGHT:
            if dx and dy and (x + y) % 2:
                continue
            ray, px, py = [], x + dx, y + dy
            while 0 <= px < w and 0 <= py < h:
                ray.append(py * w + px)
                px, py = px + dx, py + dy
            if ray:
                lines[c, (dx, dy)] = ray

    def run(points: list[int], opp: int) -> int:
        taken = 0
        for p in points:
            if not opp >> p & 1:
                break
            taken |= 1 << p
        return taken

    def captures(own: int, opp: int, c: int, been: int, last, out: set) -> None:
        for d in _EIGHT:
            ray = lines.get((c, d))
            if d == last or not ray or (own | opp | been) >> ray[0] & 1:
                continue
            ahead = run(ray[1:], opp)
            behind = run(lines.get((c, (-d[0], -d[1])), []), opp)
            for taken in {ahead, behind} - {0}:
                new = own ^ 1 << c | 1 << ray[0], opp & ~taken
                out.add(new)
                captures(*new, ray[0], been | 1 << c, d, out)

    def split(s: int):
        a, b, turn = s & (1 << n) - 1, s >> n & (1 << n) - 1, s >> 2 * n
        return (a, b, turn) if turn == 0 else (b, a, turn)

    def join(own: int, opp: int, turn: int) -> int:
        a, b = (own, opp) if turn == 0 else (opp, own)
        return a | b << n | (1 - turn) << 2 * n

    def moves(s: int) -> list[int]:
        own, opp, turn = split(s)
        found: set = set()
        for c in _cells(own):
            captures(own, opp, c, 0, None, found)
        if not found:
            for c in _cells(own):
                found |= {(own ^ 1 << c | 1 << r[0], opp) for (o, _), r in lines.items() if o == c and not (own | opp) >> r[0] & 1}
        return [join(*x, turn) for x in found]

    def value(s: int):
        own, opp, _ = split(s)
        return -1 if not own else 1 if not opp else None

    if setup is None:
        middle = "".join("." if x == w // 2 else "BW"[x % 2] if x < w // 2 else "BW"[x % 2] for x in range(w))
        if w == 3:
            middle = "B.W"
        setup = "/".join(["B" * w] * (h // 2) + [middle] + ["W" * w] * (h // 2))
    board = setup.replace("/", "")
    white = sum(1 << i for i, ch in enumerate(board) if ch == "W")
    black = sum(1 << i for i, ch in enumerate(board) if ch == "B")
    return scripted(f"fanorona {w}x{h}", [white | black << n], moves, value, -1)


def twixt(w: int, h: int) -> Game:
    """Pegs join by knight's moves that cross no link; white joins top and bottom, black left
    and right. Corners are no holes, and border rows belong to one side. No hole left, or
    neither side able to connect any more, is a draw. States are (white pegs, black pegs,
    links), so the links must fit beside the pegs in 63 bits."""
    n = w * h
    at = lambda c: (c % w, c // w)
    corner = {0, w - 1, n - w, n - 1}
    links = []
    for a, b in product(range(n), range(n)):
        (ax, ay), (bx, by) = at(a), at(b)
        if a < b and {abs(ax - bx), abs(ay - by)} == {1, 2} and not {a, b} & corner:
            links.append((a, b))
    if 2 * n + len(links) > 63:
        raise ValueError("this board needs more than 63 bits")

    def turn_of(a, b, c):
        (ax, ay), (bx, by), (cx, cy) = at(a), at(b), at(c)
        z = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
        return (z > 0) - (z < 0)

    def cross(p, q):
        return turn_of(*p, q[0]) * turn_of(*p, q[1]) < 0 and turn_of(*q, p[0]) * turn_of(*q, p[1]) < 0

    bar = [sum(1 << j for j, q in enumerate(links) if cross(p, q)) for p in links]
    mine = [sum(1 << c for c in range(n) if c not in corner and 0 < at(c)[k] < (w, h)[k] - 1) for k in (0, 1)]
    begin = [sum(1 << c for c in range(n) if at(c)[1 - k] == 0) for k in (0, 1)]
    goal = [sum(1 << c for c in range(n) if at(c)[1 - k] == (h, w)[k] - 1) for k in (0, 1)]

    def joined(cells: int, k: int, usable) -> bool:
        seen = cells & begin[k]
        while True:
            if seen & goal[k]:
                return True
            more = seen
            for i, (a, b) in enumerate(links):
                if usable(i) and cells >> a & cells >> b & 1:
                    if (more >> a & 1) != (more >> b & 1):
                        more |= 1 << a | 1 << b
            if more == seen:
                return False
            seen = more

    def split(s: int):
        return [s & (1 << n) - 1, s >> n & (1 << n) - 1], s >> 2 * n

    def turn(pegs) -> int:
        return (pegs[0].bit_count() + pegs[1].bit_count()) % 2

    def moves(s: int) -> list[int]:
        pegs, net = split(s)
        k = turn(pegs)
        out = []
        for c in _cells(mine[k] & ~(pegs[0] | pegs[1])):
            new, grown = list(pegs), net
            new[k] |= 1 << c
            for i, (a, b) in enumerate(links):
                if c in (a, b) and pegs[k] >> (a + b - c) & 1 and not grown & bar[i]:
                    grown |= 1 << i
            out.append(new[0] | new[1] << n | grown << 2 * n)
        return out

    def value(s: int):
        pegs, net = split(s)
        k = turn(pegs)
        if joined(pegs[1 - k], 1 - k, lambda i: net >> i & 1):
            return -1
        free = [mine[j] & ~pegs[1 - j] for j in (0, 1)]
        if not any(joined(free[j], j, lambda i: net >> i & 1 or not net & bar[i]) for j in (0, 1)):
            return 0
        return None

    return scripted(f"twixt {w}x{h}", [0], moves, value, 0, acyclic=True)


def quoridor(w: int, h: int, walls: int) -> Game:
    """Pawns race across the board; a wall of two cells may be set unless it shuts a pawn
    off from its goal. A pawn on its goal row has won; a side without a move draws. States
    are (pawns, turn, walls left, set walls)."""
    n, slots = w * h, [(x, y, o) for o in (0, 1) for y in range(h - 1) for x in range(w - 1)]
    index = {s: i for i, s in enumerate(slots)}
    if 2 * 6 + 1 + 8 + len(slots) > 63:
        raise ValueError("this board needs more than 63 bits")

    def clash(i: int, net: int) -> bool:
        x, y, o = slots[i]
        near = [(x, y, 1 - o), (x, y, o)] + ([(x - 1, y, 0), (x + 1, y, 0)] if o == 0 else [(x, y - 1, 1), (x, y + 1, 1)])
        return any(net >> index[s] & 1 for s in near if s in index)

    known: dict[int, list[dict]] = {}

    def steps(net: int) -> list[dict]:
        """For every cell, its open neighbours by direction."""
        if net in known:
            return known[net]
        out = []
        for c in range(n):
            x, y = c % w, c // w
            ways = {}
            for d, (dx, dy) in enumerate(_FOUR):
                if 0 <= x + dx < w and 0 <= y + dy < h:
                    if dy:
                        shut = [(x, min(y, y + dy), 0), (x - 1, min(y, y + dy), 0)]
                    else:
                        shut = [(min(x, x + dx), y, 1), (min(x, x + dx), y - 1, 1)]
                    if not any(s in index and net >> index[s] & 1 for s in shut):
                        ways[d] = c + dx + dy * w
            out.append(ways)
        if len(known) > 10_000:
            known.clear()
        known[net] = out
        return out

    def gets_there(net: int, c: int, row: int) -> bool:
        seen, todo = {c}, [c]
        while todo:
            v = todo.pop()
            if v // w == row:
                return True
            new = set(steps(net)[v].values()) - seen
            seen |= new
            todo += new
        return False

    def split(s: int):
        return s & 63, s >> 6 & 63, s >> 12 & 1, s >> 13 & 15, s >> 17 & 15, s >> 21

    def join(p, q, t, a, b, net) -> int:
        return p | q << 6 | t << 12 | a << 13 | b << 17 | net << 21

    def moves(s: int) -> list[int]:
        p, q, t, a, b, net = split(s)
        me, you = (p, q) if t == 0 else (q, p)
        ways, to = steps(net), set()
        for d, v in ways[me].items():
            if v != you:
                to.add(v)
            elif d in ways[you]:
                to.add(ways[you][d])
            else:
                to |= {u for e, u in ways[you].items() if e % 2 != d % 2}
        to.discard(me)
        out = [join(*((v, q) if t == 0 else (p, v)), 1 - t, a, b, net) for v in to]
        if (a, b)[t]:
            left = (a - (t == 0), b - (t == 1))
            for i in range(len(slots)):
                new = net | 1 << i
                if not net >> i & 1 and not clash(i, net) and gets_there(new, p, h - 1) and gets_there(new, q, 0):
                    out.append(join(p, q, 1 - t, *left, new))
        return out

    def value(s: int):
        p, q, t, *_ = split(s)
        if p // w == h - 1:
            return 1 if t == 0 else -1
        if q // w == 0:
            return 1 if t == 1 else -1
        return None

    return scripted(f"quoridor {w}x{h} w={walls}", [join(w // 2, n - w + w // 2, 0, walls, walls, 0)], moves, value, 0)


def shobu(w: int, h: int, k: int) -> Game:
    """Two boards: a passive step of one or two cells on the home board, pushing nothing,
    then the same step on the other board, which may push one enemy stone, off the board
    too. A side missing from a board has lost, and so has one that cannot move."""
    n = w * h
    heads = [(dx * r, dy * r, dx, dy, r) for dx, dy in _EIGHT for r in (1, 2)]
    full = (1 << n) - 1

    def land(c: int, dx: int, dy: int):
        x, y = c % w + dx, c // w + dy
        return y * w + x if 0 <= x < w and 0 <= y < h else None

    def ways_from(c: int) -> list[tuple]:
        """(step, cells passed and entered, landing, landing beyond for each entered cell)."""
        out = []
        for i, (dx, dy, ux, uy, r) in enumerate(heads):
            to = land(c, dx, dy)
            if to is not None:
                path = [land(c, ux * j, uy * j) for j in range(1, r + 1)]
                out.append((i, path, to, [land(p, dx, dy) for p in path]))
        return out

    ways = [ways_from(c) for c in range(n)]

    def mask(s: int, board: int, colour: int) -> int:
        return s >> (2 * board + colour) * n & full

    def moves(s: int) -> list[int]:
        t = s >> 4 * n & 1
        home, away = t, 1 - t
        own, opp = mask(s, home, t), mask(s, home, 1 - t)
        mine, theirs = mask(s, away, t), mask(s, away, 1 - t)
        passive: dict[int, set] = {}
        for c in _cells(own):
            for i, path, to, _ in ways[c]:
                if not any((own | opp) >> p & 1 for p in path):
                    passive.setdefault(i, set()).add(own ^ 1 << c | 1 << to)
        active: dict[int, set] = {}
        for c in _cells(mine):
            for i, path, to, beyond in ways[c]:
                if i not in passive or any(mine >> p & 1 for p in path):
                    continue
                pushed = [j for j, p in enumerate(path) if theirs >> p & 1]
                if len(pushed) > 1:
                    continue
                left = theirs
                if pushed:
                    left ^= 1 << path[pushed[0]]
                    end = beyond[pushed[0]]
                    if end is not None:
                        if (mine | theirs) >> end & 1:
                            continue
                        left |= 1 << end
                active.setdefault(i, set()).add((mine ^ 1 << c | 1 << to, left))
        out = set()
        for i, pairs in active.items():
            for (m, left), o in product(pairs, passive[i]):
                part = {(home, t): o, (home, 1 - t): opp, (away, t): m, (away, 1 - t): left}
                out.add(sum(v << (2 * b + c) * n for (b, c), v in part.items()) | (1 - t) << 4 * n)
        return list(out)

    def value(s: int):
        t = s >> 4 * n & 1
        gone = [c for b in (0, 1) for c in (0, 1) if not mask(s, b, c)]
        return None if not gone else -1 if t in gone else 1

    # white (0) on the far rows, black (1) on the near ones; black begins
    white, black = ((1 << k) - 1) << (n - w), (1 << k) - 1
    root = sum(m << (2 * b + c) * n for b in (0, 1) for c, m in ((0, black), (1, white))) | 1 << 4 * n
    return scripted(f"mini shobu {w}x{h} K={k}", [root], moves, value, -1)


def othello(n: int) -> Game:
    """Reversi on a small even board: a move must flip, a side without one passes, and the
    game ends when neither can move; the value is the sign of the disc difference, empty
    cells to the winner. States are side to move first."""
    size = n * n
    if 2 * size > 62:
        raise ValueError("this board needs more than 63 bits")

    def flips(own: int, opp: int, c: int) -> int:
        got = 0
        for dx, dy in _EIGHT:
            x, y, run = c % n + dx, c // n + dy, 0
            while 0 <= x < n and 0 <= y < n and opp >> (y * n + x) & 1:
                run |= 1 << (y * n + x)
                x, y = x + dx, y + dy
            if run and 0 <= x < n and 0 <= y < n and own >> (y * n + x) & 1:
                got |= run
        return got

    def plays(own: int, opp: int) -> list[tuple[int, int]]:
        return [(c, f) for c in range(size) if not (own | opp) >> c & 1 and (f := flips(own, opp, c))]

    def split(s: int):
        return s & (1 << size) - 1, s >> size

    def moves(s: int) -> list[int]:
        own, opp = split(s)
        found = plays(own, opp)
        return [(opp & ~f) | (own | f | 1 << c) << size for c, f in found] or [opp | own << size]

    def value(s: int):
        own, opp = split(s)
        if plays(own, opp) or plays(opp, own):
            return None
        d = own.bit_count() - opp.bit_count()
        return (d > 0) - (d < 0)

    a = n // 2
    root = (1 << ((a - 1) * n + a) | 1 << (a * n + a - 1)) | (1 << ((a - 1) * n + a - 1) | 1 << (a * n + a)) << size
    return scripted(f"othello {n}x{n}", [root], moves, value, 0)


def pentago(n: int) -> Game:
    """Place a stone, then turn one quadrant a quarter either way; n - 1 in a row wins for
    its owner after the turn, both at once or a full board draw. Small even boards only:
    quadrants of side n / 2, lines of n - 1. States are side to move first."""
    q, size, need = n // 2, n * n, n - 1
    lines = []
    for c, (dx, dy) in product(range(size), ((1, 0), (0, 1), (1, 1), (1, -1))):
        x, y = c % n, c // n
        if 0 <= x + dx * (need - 1) < n and 0 <= y + dy * (need - 1) < n:
            lines.append(sum(1 << ((y + dy * i) * n + x + dx * i) for i in range(need)))
    turns = []
    for ox, oy, way in product((0, q), (0, q), (0, 1)):
        perm = list(range(size))
        for x, y in product(range(q), range(q)):
            tx, ty = (q - 1 - y, x) if way else (y, q - 1 - x)
            perm[(oy + y) * n + ox + x] = (oy + ty) * n + ox + tx
        turns.append(perm)

    def turned(m: int, perm: list[int]) -> int:
        return sum(1 << perm[c] for c in _cells(m))

    def split(s: int):
        return s & (1 << size) - 1, s >> size

    def moves(s: int) -> list[int]:
        own, opp = split(s)
        return [turned(opp, p) | turned(own | 1 << c, p) << size for c in range(size) if not (own | opp) >> c & 1 for p in turns]

    def value(s: int):
        own, opp = split(s)
        a, b = any(m & own == m for m in lines), any(m & opp == m for m in lines)
        if a or b:
            return (a > b) - (a < b)
        return 0 if (own | opp).bit_count() == size else None

    return scripted(f"pentago {n}x{n}", [0], moves, value, 0, acyclic=True)


def go(w: int, h: int, plies: int) -> Game:
    """Area-scored go without repetition history, cut after so many plies: no move may bring
    back the position of one ply before, two passes end the game, and the value is the sign
    of the mover's score. A state holds the last position for that rule."""
    n = w * h
    if 4 * n + 8 > 63:
        raise ValueError("this board needs more than 63 bits")
    near = [[c + dx + dy * w for dx, dy in _FOUR if 0 <= c % w + dx < w and 0 <= c // w + dy < h] for c in range(n)]

    def group(c: int, of: int) -> int:
        out, todo = 1 << c, [c]
        while todo:
            for v in near[todo.pop()]:
                if of >> v & 1 and not out >> v & 1:
                    out |= 1 << v
                    todo.append(v)
        return out

    def alive(g: int, occ: int) -> bool:
        return any(not occ >> v & 1 for c in _cells(g) for v in near[c])

    def split(s: int):
        f = (1 << n) - 1
        return s & f, s >> n & f, s >> 2 * n & f, s >> 3 * n & f, s >> 4 * n & 3, s >> (4 * n + 2)

    def join(own, opp, last_own, last_opp, passes, ply) -> int:
        return own | opp << n | last_own << 2 * n | last_opp << 3 * n | passes << 4 * n | ply << (4 * n + 2)

    def moves(s: int) -> list[int]:
        own, opp, lo, lp, passes, ply = split(s)
        out = [join(opp, own, opp, own, passes + 1, ply + 1)]
        for c in range(n):
            if (own | opp) >> c & 1:
                continue
            mine, theirs = own | 1 << c, opp
            for v in near[c]:
                if theirs >> v & 1 and not alive(g := group(v, theirs), mine | theirs):
                    theirs &= ~g
            g = group(c, mine)
            if not alive(g, mine | theirs):
                mine &= ~g
            if (mine, theirs) != (lo, lp) and (mine, theirs) != (own, opp):
                out.append(join(theirs, mine, opp, own, 0, ply + 1))
        return out

    def value(s: int):
        own, opp, _, _, passes, ply = split(s)
        if passes < 2 and ply < plies:
            return None
        score, empty = own.bit_count() - opp.bit_count(), ((1 << n) - 1) & ~(own | opp)
        while empty:
            g = group((empty & -empty).bit_length() - 1, empty)
            empty &= ~g
            edge = {(own >> v & 1) - (opp >> v & 1) for c in _cells(g) for v in near[c]} - {0}
            if len(edge) == 1:
                score += edge.pop() * g.bit_count()
        return (score > 0) - (score < 0)

    return scripted(f"go {w}x{h}, {plies} plies", [0], moves, value, 0, acyclic=True)


#: animal shogi steps of each kind for the side that moves up: chick, giraffe, elephant, lion, hen
_STEPS = {
    "C": [(0, 1)],
    "G": [(0, 1), (0, -1), (1, 0), (-1, 0)],
    "E": [(1, 1), (1, -1), (-1, 1), (-1, -1)],
    "L": [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy],
    "H": [(0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (-1, 1)],
}
_KINDS = "CGELH"


def animal_shogi(plies: int | None = None) -> Game:
    """Animal shogi on 3 x 4. Taking the lion wins, and so does a lion that reaches the far
    row and cannot be taken there. Captured pieces are dropped; a chick turns into a hen on
    the far row. No move draws. States are the mover's view, a base-11 board and six hands
    of 0 to 2; with plies, deeper states are left out by the caller."""
    w, h = 3, 4
    n = w * h

    def decode(s: int):
        hands, board = s % 729, s // 729
        hand = [hands // 3**i % 3 for i in range(6)]
        cells = [board // 11**i % 11 for i in range(n)]
        return cells, hand

    def encode(cells, hand) -> int:
        return sum(c * 11**i for i, c in enumerate(cells)) * 729 + sum(x * 3**i for i, x in enumerate(hand))

    def turned(cells, hand) -> int:
        flip = [0 if not c else c + 5 if c <= 5 else c - 5 for c in reversed(cells)]
        return encode(flip, hand[3:] + hand[:3])

    def reach(c: int, kind: str, up: int):
        for dx, dy in _STEPS[kind]:
            x, y = c % w + dx * up, c // w + dy * up
            if 0 <= x < w and 0 <= y < h:
                yield y * w + x

    def attacked(cells, at: int) -> bool:
        return any(p > 5 and at in reach(c, _KINDS[p - 6], -1) for c, p in enumerate(cells))

    def moves(s: int) -> list[int]:
        cells, hand = decode(s)
        out = []
        for c, p in enumerate(cells):
            if not 1 <= p <= 5:
                continue
            for t in reach(c, _KINDS[p - 1], 1):
                q = cells[t]
                if 1 <= q <= 5:
                    continue
                new, held = list(cells), list(hand)
                if q:
                    held["CGELH".index({"H": "C"}.get(_KINDS[q - 6], _KINDS[q - 6])) % 3] += 1
                new[c], new[t] = 0, 5 if p == 1 and t // w == h - 1 else p
                out.append(turned(new, held))
        for k in range(3):
            if hand[k]:
                for t in range(n):
                    if not cells[t]:
                        new, held = list(cells), list(hand)
                        held[k] -= 1
                        new[t] = k + 1
                        out.append(turned(new, held))
        return out

    def value(s: int):
        cells, _ = decode(s)
        own = next((c for c, p in enumerate(cells) if p == 4), None)
        if own is None:
            return -1
        other = next((c for c, p in enumerate(cells) if p == 9), None)
        if any(1 <= p <= 5 and other in reach(c, _KINDS[p - 1], 1) for c, p in enumerate(cells)):
            return 1
        return -1 if other // w == 0 else None

    # bottom row elephant, lion, giraffe, chick before the lion; the other side turned round
    root = [3, 4, 2, 0, 1, 0, 0, 6, 0, 7, 9, 8]
    return scripted("animal shogi 3x4", [encode(root, [0] * 6)], moves, value, 0)
