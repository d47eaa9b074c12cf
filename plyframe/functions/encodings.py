"""Value codes of stored tables, brought to -1 loss, 0 draw, 1 win for the side to move,
null undecided."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: code -> value by kind of table; a code that is missing is undecided or illegal
MOVER = {
    "connect4": {0: 0, 1: 1, 2: -1},
    "nocca": {0: 0, 1: 1, 2: -1},
    "animal shogi": {0: 0, 1: 1, 2: -1},
    "chinese checkers": {0: 0, 1: 1, 2: -1},
    "fanorona": {1: 1, 2: -1, 3: 0},
    "morris": {1: -1, 2: 0, 3: 1},
    "amazons": {1: 1, 2: -1},
    "breakthrough": {0: -1, 1: 1},
    "shobu": {1: 0, 2: 1, 3: -1},
    "twixt": {-1: -1, 0: 0, 1: 1},
}


def mover_value(code: str | Column, kind: str) -> Column:
    c = F.col(code) if isinstance(code, str) else code
    out = F.lit(None).cast("int")
    for k, v in MOVER[kind].items():
        out = F.when(c == k, v).otherwise(out)
    return out


def from_winner(code: str | Column, turn: str | Column) -> Column:
    """0 draw, 1 or 2 the winning player; turn 0 or 1 is the player to move."""
    c, t = (F.col(x) if isinstance(x, str) else x for x in (code, turn))
    return F.when(c == 0, 0).when(c == t + 1, 1).when(c.isin(1, 2), -1)


def from_black(code: str | Column, black_to_move: str | Column) -> Column:
    """1 black reaches its aim, 2 it does not."""
    c, b = (F.col(x) if isinstance(x, str) else x for x in (code, black_to_move))
    return F.when(c == 1, F.when(b, 1).otherwise(-1)).when(c == 2, F.when(b, -1).otherwise(1))
