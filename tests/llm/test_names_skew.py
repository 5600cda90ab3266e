"""Many organisations of one place, and likelihoods that come from the column."""

import itertools
import random
import time

from shelfspark.llm import names


def test_organisations_of_one_place(spark):
    rnd = random.Random(4)
    letters = "bcdfghklmnprstvw"
    words = sorted({"".join(rnd.choice(letters) + rnd.choice("aeiou") for _ in range(4)) for _ in range(90)})[:80]
    kinds = ["Institute", "Centre", "Society", "Museum", "Library"]
    whole = [f"{k} for {a.title()} and {b.title()}, Ravelinford" for k in kinds for a, b in itertools.combinations(words, 2)]
    a, b = words[3], words[40]
    variants = [f"Inst. for {b.title()} and {a.title()}, Ravelinford", f"Institute for {a.title()} & {b[:-2] + b[-1].title()}, Ravelinford", f"INSTITUTE FOR {a.upper()} AND {b.upper()}, RAVELINFROD"]
    rows = [(k, t, 9, 0) for k, t in enumerate(whole)] + [(100_000 + k, t, 1, 0) for k, t in enumerate(variants)]
    began = time.perf_counter()
    got = {r.name_id: r.entity for r in names.entities(spark.createDataFrame(rows, "name_id bigint, person_name string, n_author int, n_editor int")).collect()}
    assert time.perf_counter() - began < 120
    home = whole.index(f"Institute for {a.title()} and {b.title()}, Ravelinford")
    assert {got[100_000 + k] for k in range(3)} == {got[home]}
    assert len(whole) > 15_000 and len(set(got.values())) > 0.9 * len(whole)


def test_likelihoods_follow_the_column(spark):
    rows = [(0, 1, True, 50, 1, 0, 0, 0, 0), (2, 1, True, 50, 1, 0, 0, 0, 0), (3, 1, True, 50, 0, 1, 0, 0, 0), (4, 1, True, 50, 1, 0, 0, 0, 0)] * 20
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    p = names.likelihoods(spark.createDataFrame(rows, "x bigint, c bigint, up boolean, n bigint, typo int, initial int, middle int, short int, acronym int"))
    assert p["typo"] == 0.5 and 0.2 < p["initial"] < 0.3 and p["acronym"] < 0.01
