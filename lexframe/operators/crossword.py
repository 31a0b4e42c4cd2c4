"""Crosswords from a word list: one layout per seed, many seeds in parallel."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The generator's and the sweep's own sizes.
RESTARTS, SEEDS, POOLS = 30, 50, (2, 4, 6, 8, 10, 15, 20, 30, 50, 100, 300)
TASKS = 110
LIST = 20_000  # words that may go to one task
OUT = "seed int, number int, direction string, x int, y int, word string, clue string"


def _noise(*parts: object) -> float:
    """A number in [0, 1) fixed by its parts."""
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=7).digest(), "big") / (1 << 56)


Slot = tuple[int, int, int]  # row, column, and 1 for down or 0 for across


class Board:
    """A sparse board: its letters by cell, its cells by letter, and the directions each cell is used in."""

    def __init__(self) -> None:
        self.letter: dict[tuple[int, int], str] = {}
        self.where: dict[str, list[tuple[int, int]]] = {}
        self.used: dict[tuple[int, int], set[int]] = {}
        self.words: list[tuple[str, Slot]] = []

    @staticmethod
    def squares(word: str, slot: Slot) -> list[tuple[int, int]]:
        row, col, down = slot
        return [(row + n * down, col + n * (1 - down)) for n in range(len(word))]

    def write(self, word: str, slot: Slot) -> None:
        for square, c in zip(self.squares(word, slot), word):
            if square not in self.letter:
                self.letter[square] = c
                self.where.setdefault(c, []).append(square)
            self.used.setdefault(square, set()).add(slot[2])
        self.words.append((word, slot))

    def slots(self, word: str) -> dict[Slot, int]:
        """Every slot of a word that crosses what is there, with the number of letters it would share.

        The cells of each of its letters are looked up; a cell used in one direction only offers the
        other. The hits of a slot are its crossings, and it stands if every other cell of it is free
        and borders on nothing, and if the word neither continues nor is continued by another.
        """
        hits: dict[Slot, int] = {}
        for n, c in enumerate(word):
            for row, col in self.where.get(c, ()):
                if len(self.used[row, col]) == 1:
                    down = 1 - next(iter(self.used[row, col]))
                    slot = (row - n * down, col - n * (1 - down), down)
                    hits[slot] = hits.get(slot, 0) + 1
        return {slot: n for slot, n in hits.items() if self._stands(word, slot, n)}

    def _stands(self, word: str, slot: Slot, crossings: int) -> bool:
        squares, down = self.squares(word, slot), slot[2]
        if sum(q in self.letter for q in squares) != crossings:  # some letter there is another one, or in line with the word
            return False
        ends = ((slot[0] - down, slot[1] - (1 - down)), (squares[-1][0] + down, squares[-1][1] + (1 - down)))
        free = (q for q in squares if q not in self.letter)
        return not any(q in self.letter for q in ends) and not any((r + (1 - down) * k, c + down * k) in self.letter for r, c in free for k in (-1, 1))

    def bounds(self) -> tuple[int, int, int, int]:
        """First row and column, height and width."""
        rows, cols = [r for r, _ in self.letter], [c for _, c in self.letter]
        return min(rows), min(cols), max(rows) - min(rows) + 1, max(cols) - min(cols) + 1


def layout(words: list[str], seed: int, target: int, start: int = 0) -> list[tuple[str, int, int, bool]]:
    """(word, x, y, across): words in a shuffled order in which longer ones tend to come first, each in its most crossed slot.

    Of equally crossed slots the one nearest to the middle of the board is taken, so layouts stay compact; each start shuffles anew.
    """
    board = Board()
    for word in sorted(words, key=lambda w: (-len(w) * (0.7 + 0.6 * _noise(seed, start, w)), w)):
        if len(board.words) == target:
            break
        if not board.words:
            board.write(word, (0, 0, 0))
            continue
        slots = board.slots(word)
        if slots:
            top, left, height, width = board.bounds()
            far = lambda s: abs(2 * s[0] + s[2] * (len(word) - 1) - 2 * top - height + 1) + abs(2 * s[1] + (1 - s[2]) * (len(word) - 1) - 2 * left - width + 1)  # noqa: B023, E731
            board.write(word, min(slots, key=lambda s: (-slots[s], far(s), s)))
    return [(w, col, row, not down) for w, (row, col, down) in board.words]


def _area(placed: list[tuple[str, int, int, bool]]) -> int:
    width = max(x + (len(w) if across else 1) for w, x, _, across in placed) - min(x for _, x, _, _ in placed)
    return width * (max(y + (1 if across else len(w)) for w, _, y, across in placed) - min(y for _, _, y, _ in placed))


def generate(words: list[str], seed: int, target: int, restarts: int = RESTARTS) -> list[tuple[str, int, int, bool]]:
    """The layout of most words, then least area, of several starts."""
    out = [layout(words, seed, target, start) for start in range(restarts)] if words else []
    return min(out, key=lambda p: (-len(p), _area(p)), default=[])


def puzzles(words: DataFrame, seeds: int, target: int = 12, restarts: int = RESTARTS) -> DataFrame:
    """OUT: for each seed 0..seeds-1 the best layout of ``restarts`` with numbered entries, coordinates from 0.

    words: word, clue; a list of at most LIST words, which goes to each seed's task whole.
    """
    rows = words.select("word", "clue").limit(LIST + 1).collect()
    if len(rows) > LIST:
        raise ValueError(f"a crossword takes at most {LIST} words; draw a sample first")
    clue = {r["word"]: r["clue"] for r in rows}

    def one(seeds_: pd.Series) -> pd.DataFrame:
        rows = []
        for seed in seeds_:
            placed = generate(sorted(clue), int(seed), target, restarts)
            x0, y0 = (min(p[k] for p in placed) for k in (1, 2)) if placed else (0, 0)
            starts = sorted({(y - y0, x - x0) for _, x, y, _ in placed})
            rows += [(int(seed), starts.index((y - y0, x - x0)) + 1, "A" if a else "D", x - x0, y - y0, w.upper(), clue[w]) for w, x, y, a in placed]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    # A task per seed: the partitions of the range as they are, which no shuffle puts together.
    return words.sparkSession.range(0, seeds, 1, max(1, seeds)).mapInPandas(lambda pdfs: (one(pdf["id"]) for pdf in pdfs), OUT)


def best(p: DataFrame) -> DataFrame:
    """The layout with most words, then least area, then lowest seed."""
    size = p.groupBy("seed").agg(
        F.count(F.lit(1)).alias("n"),
        ((F.max(F.col("x") + F.when(F.col("direction") == "A", F.length("word") - 1).otherwise(0)) + 1) * (F.max(F.col("y") + F.when(F.col("direction") == "D", F.length("word") - 1).otherwise(0)) + 1)).alias("area"),
    )
    return p.join(size.orderBy(F.desc("n"), "area", "seed").limit(1), "seed").drop("n", "area")


def faults(p: DataFrame) -> DataFrame:
    """rule, n: how often the layouts of ``puzzles`` break each rule: letters agree, words hang together, no word comes twice, numbers follow the starts, all is on the board."""
    down = (F.col("direction") == "D").cast("int")
    cells = p.select("seed", "word", "direction", F.posexplode(F.split("word", "")).alias("i", "c"), "x", "y").select("seed", "word", (F.col("x") + F.col("i") * (1 - down)).alias("cx"), (F.col("y") + F.col("i") * down).alias("cy"), "c")
    by = cells.groupBy("seed", "cx", "cy").agg(F.countDistinct("c").alias("letters"), F.count(F.lit(1)).alias("words"))
    alone = cells.join(by, ["seed", "cx", "cy"]).groupBy("seed", "word").agg(F.max("words").alias("most"))
    many = p.groupBy("seed").agg(F.count(F.lit(1)).alias("all"))
    twice = p.groupBy("seed", "word").agg(F.count(F.lit(1)).alias("k"))
    starts = p.select("seed", "x", "y", "number").distinct()
    rank = F.dense_rank().over(Window.partitionBy("seed").orderBy("y", "x"))
    one = lambda df, rule: df.agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.lit(rule).alias("rule"), "n")
    parts = [
        one(by.where("letters > 1"), "letters differ"), one(alone.join(many, "seed").where("most < 2 AND all > 1"), "word apart"), one(twice.where("k > 1"), "word twice"),
        one(starts.withColumn("r", rank).where("r <> number"), "number differs"), one(p.where("x < 0 OR y < 0"), "off the board"),
    ]
    return reduce(DataFrame.unionByName, parts)


def draws(words: DataFrame, size: int, seeds: int) -> DataFrame:
    """seed, rank, word: for each seed the first ``size`` words in the order of a hash with the seed."""
    drawn = words.select("word").distinct().crossJoin(F.broadcast(words.sparkSession.range(seeds).select(F.col("id").cast("int").alias("seed"))))
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.md5(F.concat(F.col("seed").cast("string"), F.lit("/"), "word")), "word"))
    return drawn.withColumn("rank", rank).where(F.col("rank") <= size)


def sweep(words: DataFrame, pools: tuple[int, ...] = POOLS, seeds: int = SEEDS, target: int = 12, restarts: int = RESTARTS) -> DataFrame:
    """pool, seeds, words (on average), complete: how layouts fare with pools of n words, drawn anew for each seed."""
    drawn = draws(words, max(pools), seeds).groupBy("seed").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("drawn"))

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            k = [len(generate(sorted(d[:pool]), int(seed), target, restarts)) for seed, pool, d in zip(pdf["seed"], pdf["pool"], pdf["drawn"])]
            yield pd.DataFrame({"pool": pdf["pool"], "k": pd.Series(k, dtype="int64")})

    each = drawn.select("seed", F.explode(F.array(*[F.lit(n) for n in pools])).alias("pool"), "drawn")
    # The rows are few and small and the work on each is long, so the number of tasks is set.
    per = each.repartition(min(len(pools) * seeds, TASKS)).mapInPandas(run, "pool int, k bigint")
    return per.groupBy("pool").agg(F.count(F.lit(1)).alias("seeds"), F.round(F.avg("k"), 6).alias("words"), F.count_if(F.col("k") >= target).alias("complete"))
