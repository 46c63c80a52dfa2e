"""Small tables that hold what no real one has at once: nulls, empty and long texts, repeated rows, extra columns with clashing names."""

import random

LOREM = "the of and to in is that for with was on are as they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, score double, items string, `key` string"


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(LOREM) + str(r.randrange(50)) for _ in range(n))


def near(text: str, changes: int, seed: int) -> str:
    r, w = random.Random(seed), text.split()
    for _ in range(changes):
        w[r.randrange(len(w))] = f"x{r.randrange(1000)}"
    return " ".join(w)


def texts() -> list[tuple[int | None, str | None]]:
    base = words(300, 1)
    shared = words(60, 2)
    rows: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "One TWO"), (6, "a b c d e"), (7, "Ä b c d e"), (8, "ä b c d e"), (9, base), (10, base.upper()), (None, base), (None, None), (11, "x" * 5000 + " y"), (12, "z y x"), (12, "z y x"), (12, "other text of the same id here")]
    rows += [(20 + k, near(base, k % 7, k)) for k in range(25)]
    rows += [(60 + k, shared + " " + words(200, 100 + k)) for k in range(20)]
    rows += [(100 + k, near(words(3000, 7), 20 * k, k)) for k in range(8)]
    return rows


def documents(spark, rows=None, extra: bool = True):
    rows = texts() if rows is None else rows
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    full = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), 7, 8, 0.5, "items", "key") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def vectors(n: int = 300, seed: int = 3):
    r = random.Random(seed)
    out: list[tuple[int | None, list | None, int]] = []
    for k in range(n):
        if k and k % 4 == 0:
            out.append((k, [x + r.gauss(0, 0.12) for x in out[k - 1 - r.randrange(min(k, 9))][1]], 0))
        else:
            out.append((k, [r.gauss(0, 1) for _ in range(16)], 0))
    same = out[1][1]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 16, [nan, *same[1:]], [inf, *same[1:]], [None, *same[1:]], [1.0, 2.0]]
    return out + [(1000 + k, list(same), 0) for k in range(15)] + [(2000 + 100 * k, v, 0) for k, v in enumerate(odd)] + [(None, list(same), 0)]
