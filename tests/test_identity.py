"""Who is who: sounds against a plain recursion, candidates, comparison, shares, groups, merges."""

import datetime as dt
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from pitchlake.functions import sounds
from pitchlake.operators import linkage, merging, names

D = dt.date

#: Spellings that are one name, and pairs that are not.
SPELLED = {
    "محمد": ("Mohamed", "Mohammed", "Muhammad", "Mahmoud"), "حسن": ("Hassan", "Hasan"), "حسين": ("Hussein", "Hosein"), "أحمد": ("Ahmed", "Ahmad"), "عبد الرحمن": ("Abdelrahman", "Abd El-Rahman", "Abdul Rahman", "Abdrahman"),
    "عمرو": ("Amr", "Amro"), "عبد الله": ("Abdallah", "Abdalla"), "فاطمة": ("Fatma", "Fatmah"), "سعد": ("Saad", "Sa'ad"), "إيمان": ("Iman", "Eman"), "السيد": ("Elsayed", "El Sayed"), "منير": ("Mounir",), "شريف": ("Sherif", "Chérif"), "يحيى": ("Yahia",), "خالد": ("Khaled",), "آدم": ("Adam",), "عادل": ("Adel",),
}
APART = (("حسين", "hassan"), ("حسن", "hussein"), ("محمد", "khaled"), ("عادل", "odel"), ("منير", "monr"))


def test_spellings_meet_and_others_do_not():
    for arabic, spellings in SPELLED.items():
        (a,) = sounds.words(arabic)
        for s in spellings:
            (b,) = sounds.words(s)
            assert sounds.same_word(a, b) and sounds.same_word(b, a), (arabic, s)
            assert sounds.meeting_key(sounds.arabic_sounds(a)) in {sounds.meeting_key(x) for x in sounds.latin_lines(b)}
        for s, t in itertools.combinations(spellings, 2):
            assert sounds.same_word(*sounds.words(s), *sounds.words(t)) or arabic in ("محمد",) or {s, t} & {"Abdallah", "Abdalla"}
    for a, b in APART:
        assert not sounds.same_word(a, b), (a, b)
    assert sounds.word_key("محمد") == sounds.word_key("mohamed") == "mm" and sounds.word_key("أحمد") == sounds.word_key("ahmed")
    assert sounds.words("  عَبد  الرحمن Abd El-Rahman O'Néil 12 ") == ["عبد الرحمن", "abdrahman", "oneil"]
    assert sounds.words(None) == sounds.words("") == [] and sounds.words("Abd") == ["abd"]


def plain_spells(arabic, line):
    """Whether a sound line spells an Arabic word, by trying each unit one after the other."""
    units = []
    for k, (article, letters) in enumerate(sounds._parts(arabic)):
        if k and article:
            units.append("l?")
        before, whole = None, letters
        for i, c in enumerate(letters):
            if c in "عءؤئ" or (c in "اأإآ" and i == 0):
                if i == 0 and k == 0:
                    after = letters[1:2]
                    units.append(("start", "a" if c == "آ" or after == "ا" else sounds.LONG[after] + "a" if after in ("ي", "و") and len(letters) > 2 else None))
                    skip = c != "آ" and (after == "ا" or (after in ("ي", "و") and len(letters) > 2))
                    letters = letters[:1] + (" " if skip else letters[1:2]) + letters[2:]
                else:
                    units.append("v?")
                before = None
            elif letters[i] == " ":
                continue
            elif i == 0 and c in "وي":
                before = "w" if c == "و" else "y"
                units.append(before)
            elif c == "و" and i == len(letters) - 1 and whole[i - 1] not in "اوي":
                units.append("v?")
                before = None
            elif c in sounds.LONG:
                units.append(("long", sounds.LONG[c]))
                before = None
            elif c == "ه" and i == len(letters) - 1:
                units.append("h?")
                before = None
            elif c in sounds.ARABIC_LETTERS:
                if sounds.ARABIC_LETTERS[c] != before:
                    units.append(sounds.ARABIC_LETTERS[c])
                before = sounds.ARABIC_LETTERS[c]
    pieces = []
    while line:
        end = line.index("]") + 1 if line[0] == "[" else 1
        pieces.append(line[:end])
        line = line[end:]
    vowel = lambda p: p[0] == "["

    def spells(u, p, run):
        """``run``: what is left of the vowels of the piece before p, which units may still use."""
        if u == len(units):
            return all(vowel(x) or x == "H" for x in pieces[p:])
        unit, piece = units[u], pieces[p] if p < len(pieces) else ""
        if isinstance(unit, tuple) and unit[0] == "start":
            return u == 0 and p == 0 and bool(piece) and vowel(piece) and (unit[1] is None or bool(set(piece) & set(unit[1]))) and spells(1, 1, piece[1:-1])
        if isinstance(unit, tuple):
            places = [i for i, c in enumerate(run) if c in unit[1]] if run is not None else []
            if places:
                return spells(u + 1, p, run[places[0] + 1 :])
            if run is not None or not piece or not vowel(piece):
                return False
            inside = [i for i, c in enumerate(piece[1:-1]) if c in unit[1]]
            return bool(inside) and spells(u + 1, p + 1, piece[1:-1][inside[0] + 1 :])
        if unit == "v?":
            return spells(u + 1, p, run) or bool(piece and vowel(piece) and run is None and spells(u + 1, p + 1, piece[1:-1]))
        if unit in ("h?", "l?"):
            return spells(u + 1, p, None) or (piece in (("h", "H") if unit == "h?" else ("l",)) and spells(u + 1, p + 1, None))
        if piece and vowel(piece):
            return (len(piece) == 3 or piece == "[ou]") and spells(u, p + 1, None)
        return bool(piece) and (piece == unit or (piece == "H" and unit == "h")) and spells(u + 1, p + 1, None)

    return spells(0, 0, None)


def test_patterns_equal_a_plain_recursion():
    rng = random.Random(3)
    letters, latin = "ابتحدرسعفكلمنهوي", "abdehiklmnorstuwy"
    compared = met = 0
    for _ in range(3000):
        arabic = "".join(rng.choice(letters) for _ in range(rng.randint(2, 6)))
        heard = sounds.arabic_sounds(arabic)
        word = "".join(c + rng.choice(("", "", "a", "e", "i", "o", "u", "ou", "ei", "aa", "y")) for c in rng.choice(("", "a", "i", "ou")) + heard.lower().replace("x", "kh"))
        word = word if rng.random() < 0.7 and word else "".join(rng.choice(latin) for _ in range(rng.randint(2, 7)))
        for line in sounds.latin_lines(word):
            got = bool(re.fullmatch(sounds.arabic_pattern(arabic), line))
            assert got == plain_spells(arabic, line), (arabic, word, line, sounds.arabic_pattern(arabic))
            compared, met = compared + 1, met + got
            assert not got or sounds.meeting_key(sounds.arabic_sounds(arabic)) == sounds.meeting_key(line)
    assert compared >= 3000 and met > 200


PEOPLE = [(1, "محمد صلاح حامد", None), (2, "Mohamed Salah", None), (3, "Mohammed Salah Hamed", "Momo"), (4, "خالد سعيد", None), (5, None, "Khaled Said"), (6, "", None), (7, "José Luis", None), (8, "Mohamed Salah", None)]


def test_names_are_found_across_scripts(spark):
    people = spark.createDataFrame(PEOPLE, "id long, name string, known_as string")
    asked = spark.createDataFrame([("Muhammad",), ("صلاح محمد",), ("khalid saied",), ("",), (None,), ("Salah Hamed",)], "query string")
    got = {(r["query"], r["id"]) for r in names.find_names(asked, people, "id", ["name", "known_as"]).collect()}
    want = set()
    for (q,) in [("Muhammad",), ("صلاح محمد",), ("khalid saied",), ("Salah Hamed",)]:
        for i, *held in PEOPLE:
            w = [x for n in held for x in sounds.words(n)]
            if all(any(sounds.same_word(a, b) for b in w) for a in sounds.words(q)):
                want.add((q, i))
    assert got == want and ("Muhammad", 1) in got and ("khalid saied", 4) in got and ("Salah Hamed", 1) in got
    assert names.find_names(asked, people.limit(0), "id", ["name"]).count() == 0


def comparable_people(spark, rows):
    """rows: id, full name, birth date, sex, sport, nationality, clubs."""
    df = spark.createDataFrame(rows, "id long, name string, date_of_birth date, sex string, sport string, nationality array<string>, clubs array<string>")
    held = names.words_of(df, "id", ["name"]).cache()
    w = held.join(names.comparable(names.vocabulary(held)), "word").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "w"))).alias("l"), F.array_sort(F.collect_set(F.nullif("key", F.lit("")))).alias("keys"))
    return df.join(w.select("id", F.col("l.w").alias("words"), "keys"), "id", "left").withColumn("given", F.col("words")[0]).withColumn("tokens", F.split(F.lower("name"), " ")).cache()


def test_candidates_and_levels(spark):
    rows = [
        (1, "محمد صلاح حامد", D(2010, 6, 15), "M", "football", ["EG"], ["a"]), (2, "Mohammed Salah Hamed", None, "M", "football", ["EG", "FR"], ["b"]), (3, "Mohamed Salah", None, "F", "judo", [], None),
        (4, "محمد صلاح", D(2005, 1, 1), "M", None, ["FR"], ["a", "b"]), (5, "Ahmed Bilal Shalaby", D(2010, 3, 7), "M", "football", None, []), (6, "أحمد بلال شلبي", D(2010, 7, 3), None, "football", ["EG"], ["a"]),
        (7, "Bilal Ibrahim Shalaby", D(2010, 3, 9), "M", "football", ["EG"], ["a"]), (8, "José Luis Morales", D(2010, 11, 20), "M", "football", ["ES"], ["c"]), (9, "José Ángel Crespo", D(2010, 11, 20), "M", "football", ["ES"], ["c"]), (10, "Kaká", D(2011, 1, 1), "M", "football", ["BR"], ["c"]), (11, "Kaká Leite", D(2010, 12, 31), "M", "football", ["BR"], ["c"]),
    ]
    r = comparable_people(spark, rows)
    got = {(x["a"], x["b"]) for x in linkage.name_candidates(r, "id", "keys", "sex", "date_of_birth").collect()}
    keys = {x["id"]: set(x["keys"]) for x in r.collect()}
    want = set()
    for (i, _, da, sa, *_), (j, _, db, sb, *_) in itertools.combinations(rows, 2):
        enough = len(keys[i] & keys[j]) >= min(2, len(keys[i]), len(keys[j]))
        if enough and not (sa and sb and sa != sb) and not (da and db and abs(da.year - db.year) > 1):
            want.add((i, j))
    assert got == want and {(1, 2), (2, 4), (5, 6), (10, 11)} <= got and not {(2, 3), (1, 4)} & got
    pairs = spark.createDataFrame([(1, 2), (1, 4), (1, 3), (5, 6), (5, 7), (8, 9), (10, 11), (5, 8)], "a long, b long")
    level = {(x["a"], x["b"]): x for x in linkage.seven_levels(pairs, r, "id").collect()}
    assert [level[p]["name"] for p in ((1, 2), (1, 4), (8, 9), (10, 11))] == ["all", "all-one-word", "none", "unknown"]
    assert [level[p]["given"] for p in ((5, 6), (5, 7))] == ["same", "different"]
    assert [level[p]["dob"] for p in ((5, 6), (5, 7), (8, 9), (1, 2), (5, 8))] == ["transposed", "near", "exact", "unknown", "conflict"]
    assert [level[p]["nationality"] for p in ((1, 2), (1, 4), (1, 3))] == ["same", "different", "unknown"]
    assert [level[p]["club"] for p in ((1, 2), (1, 4), (5, 6))] == ["different", "same", "unknown"]
    assert [level[p]["sex"] for p in ((1, 3), (5, 6))] == ["different", "unknown"] and level[1, 4]["sport"] == "unknown"


def test_shares_are_recovered(spark):
    """m and u as counted, and the share of true pairs by expectation-maximisation, planted."""
    rng = random.Random(5)
    m = {"name": (("all", 0.8), ("most", 0.2)), "given": (("same", 0.9), ("different", 0.1)), "dob": (("exact", 0.7), ("near", 0.2), ("unknown", 0.1))}
    u = {"name": (("most", 0.1), ("some", 0.5), ("none", 0.4)), "given": (("same", 0.2), ("different", 0.8)), "dob": (("near", 0.05), ("conflict", 0.85), ("unknown", 0.1))}
    draw = lambda t: {f: rng.choices([x for x, _ in t[f]], [p for _, p in t[f]])[0] if f in t else "unknown" for f in linkage.LEVELS}
    of = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{f} string" for f in linkage.LEVELS))
    true, false = [draw(m) for _ in range(600)], [draw(u) for _ in range(6000)]
    mm, uu = linkage.level_shares(of(true)), linkage.level_shares(of(false))
    for planted, counted in ((m, mm), (u, uu)):
        for f, levels in planted.items():
            assert sum(counted[f].values()) == pytest.approx(1)
            for lv, p in levels:
                assert counted[f][lv] == pytest.approx(p, abs=0.05)
    patterns = linkage.pattern_counts(of(true + false), list(linkage.LEVELS))
    assert len(patterns) > 10
    share = linkage.fit_share(patterns, mm, uu, list(linkage.LEVELS), every=1_000_000, prior=0.01)
    assert share == pytest.approx(600 / 1_000_000, rel=0.1)
    assert linkage.level_weight(mm, uu, "dob", "unknown") == 0 and linkage.level_weight(mm, uu, "dob", "conflict") < -1


def in_order(pairs, least=0.5):
    """Groups by taking the links one after the other."""
    bad = {k for k, (_, c) in pairs.items() if c}
    group = {i: i for (a, b), (p, c) in pairs.items() if p >= least and not c for i in (a, b)}
    members = {i: {i} for i in group}
    foes = {i: set() for i in group}
    for a, b in bad:
        if a in group and b in group:
            foes[a].add(b)
            foes[b].add(a)
    for _, a, b in sorted((-p, a, b) for (a, b), (p, c) in pairs.items() if p >= least and not c):
        x, y = sorted((group[a], group[b]))
        if x != y and not any(members[x] & foes[j] for j in members[y]):
            for j in members[y]:
                group[j] = x
            members[x] |= members.pop(y)
    return group


def shapes():
    rng = random.Random(11)
    chance = lambda ties: rng.choice((0.6, 0.9)) if ties else round(rng.random() / 2 + 0.5, 6)
    star = lambda n: {(0, i): (chance(True), False) for i in range(1, n)} | {(i, i + 1): (0.9, True) for i in range(1, 40, 2)}
    chain = lambda n: {(i, i + 1): (chance(False), False) for i in range(n)} | {(i, i + n // 2): (0.9, True) for i in range(0, n // 2, 10)}
    clique = {(a, b): (chance(True), a % 20 == 0 and b % 20 == 7) for a, b in itertools.combinations(range(120), 2)}
    return {"star": star(1000), "small star": star(60), "chain": chain(1000), "clique": clique}


def test_a_long_path_is_one_component(spark):
    ids = list(range(3000))
    random.Random(5).shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    assert {tuple(r) for r in linkage.components(df).collect()} == {(i, 0) for i in ids}


@pytest.mark.parametrize("shape, most", [("star", 100_000), ("small star", 50), ("clique", 100_000)])
def test_groups_of_any_shape_equal_links_in_order(spark, shape, most):
    pairs = shapes()[shape]
    df = spark.createDataFrame([(a, b, p, c) for (a, b), (p, c) in pairs.items()], "a long, b long, probability double, conflict boolean")
    got = {r["id"]: r["group"] for r in linkage.greedy_groups(df, "conflict", most=most).collect()}
    assert got == in_order(pairs)


def many_people(spark):
    """Records with few names, in both scripts, and all that a comparison can lack."""
    named = ["محمد صلاح حامد", "Mohammed Salah Hamed", "Mohamed Salah", "محمد صلاح", "Kaká", "Kaká Leite", "Ahmed Bilal Shalaby", "Salah Hamed Mohamed", "Bilal Belal Bilal", ""]
    born = [D(2010, 6, 5), D(2010, 5, 6), D(2010, 6, 9), D(2011, 1, 1), None, D(2005, 1, 1)]
    rng = random.Random(8)
    return comparable_people(spark, [(i, rng.choice(named), rng.choice(born), rng.choice("MFM") if i % 9 else None, rng.choice(("football", "judo", None)), rng.choice(([], ["EG"], ["EG", "FR"], ["FR"], None, [None])), rng.choice((["a"], ["b", "a"], ["b"], None))) for i in range(150)])


def test_patterns_of_candidates_tell_their_levels_and_names_are_compared_by_classes(spark):
    r, fields = many_people(spark), list(linkage.LEVELS)
    pairs = linkage.name_candidates(r, "id", "keys", "sex", "date_of_birth")
    want = sorted(map(tuple, linkage.seven_levels(pairs, r, "id").select("a", "b", *fields).collect()))
    told = linkage.candidate_patterns(r, "id", "keys").join(linkage.patterns(spark), "pattern")
    assert sorted(map(tuple, told.select("a", "b", *fields).collect())) == want and len(want) > 300
    classes = linkage.name_classes(r, "id", "keys", "sex", "date_of_birth", ("words", "given", "tokens"))
    met = linkage.classes_met(classes)
    assert classes.count() <= 27 and met.count() < len(want)  # nine names, three sexes
    parts = linkage.name_classes(r, "id", "keys", "sex", "date_of_birth", most=4)
    assert parts.select(F.max(F.aggregate("years", F.lit(0), lambda n, y: n + F.size(y["members"])))).first()[0] == 4
    found = linkage.class_members(linkage.classes_met(parts)).select(F.least("x.id", "y.id"), F.greatest("x.id", "y.id"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, pairs.collect()))


def test_groups_hold_no_conflict_that_the_candidates_leave_out(spark, monkeypatch):
    from pitchlake.plans import identity

    rows = [(1, D(2001, 5, 5), "M"), (2, None, "M"), (3, D(2005, 9, 9), "M"), (4, D(2001, 5, 5), None), (5, D(2001, 5, 6), "F")]
    r = comparable_people(spark, [(i, "Karim Nasir Badran", born, sex, "judo", ["EG"], ["a"]) for i, born, sex in rows]).withColumnRenamed("id", "record_id")
    told = linkage.patterns(spark).withColumn("probability", F.when(F.col("name") == "all", 0.9).otherwise(0.1))
    monkeypatch.setattr(identity, "scored", lambda *_: (r, told))
    _, strong, groups = identity.grouped(spark, "")
    assert sorted((x["a"], x["b"]) for x in strong.collect()) == [(1, 2), (1, 4), (2, 3), (2, 4), (4, 5)]
    assert {x["id"]: x["group"] for x in groups.collect()} == {1: 1, 2: 1, 4: 1, 3: 3, 5: 5}


# --- merges -----------------------------------------------------------------------------------


def tables(spark):
    make = spark.createDataFrame
    return {
        "players": make([(i, "active", None) for i in range(1, 9)], "player_id long, status string, merged_into long"),
        "readings": make([(1, 1, "h", "d1"), (2, 2, "h", "d1"), (3, 2, "h", "d2"), (4, 2, "h", "d2"), (5, 3, "h", "d2"), (6, 3, "h", "d3"), (7, 3, None, None), (8, 1, None, None), (9, None, "h", "d9")], "id long, player_id long, metric string, day string"),
        "rows": make([(1, 1, 5, "x"), (2, 2, 5, "x"), (3, 2, 5, "y"), (4, 2, 1, "z"), (5, 5, 2, "x"), (6, 1, 2, "w"), (7, 6, 3, "v")], "id long, player_id long, opponent_id long, metrics string"),
        "flags": make([("a", 2, None, "open"), ("b", 5, 3, "in_review"), ("c", 2, 3, "confirmed"), ("d", 7, 8, "open")], "dedupe_key string, player_id long, related long, status string"),
    }


MOVES = (merging.Moves("readings", "id", "player_id", ("metric", "day")), merging.Moves("rows", "id", "player_id", ("opponent_id", "metrics"), "opponent_id"), merging.Moves("rows", "id", "opponent_id", (), "player_id"))
IDS = {"players": "player_id", "readings": "id", "rows": "id", "flags": "dedupe_key"}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merges_move_what_the_survivor_lacks_and_an_undo_takes_them_back(spark):
    before = tables(spark)
    pointers = spark.createDataFrame([(2, 1), (3, 2)], "gone long, keep long")  # 3 into 2 into 1
    after, journal = merging.merge(before, pointers, MOVES, flags="flags")
    owner = {r["id"]: r["player_id"] for r in after["readings"].collect()}
    # 2 is taken in before 3: its two readings of d2 move together, 3's of that day stays
    assert owner == {1: 1, 2: 2, 3: 1, 4: 1, 5: 3, 6: 1, 7: 3, 8: 1, 9: None}
    got = {r["id"]: (r["player_id"], r["opponent_id"]) for r in after["rows"].collect()}
    # 4 stays with 2, as it is against the survivor; 6 would be the survivor against themselves
    assert got == {1: (1, 5), 2: (2, 5), 3: (1, 5), 4: (2, 1), 5: (5, 1), 6: (1, 2), 7: (6, 1)}
    assert {r["player_id"]: (r["status"], r["merged_into"]) for r in after["players"].collect() if r["player_id"] < 4} == {1: ("active", None), 2: ("merged", 1), 3: ("merged", 1)}
    assert {r["dedupe_key"]: r["status"] for r in after["flags"].collect()} == {"a": "dismissed", "b": "dismissed", "c": "confirmed", "d": "open"}
    assert all(rows_of(merging.undo(after, journal, IDS)[n]) == rows_of(before[n]) for n in before)
    some = merging.undo(after, journal, IDS, spark.createDataFrame([(3,)], "gone long"))
    assert {r["id"]: r["player_id"] for r in some["readings"].collect()} == {**owner, 6: 3}
    assert {r["player_id"]: r["merged_into"] for r in some["players"].collect() if r["player_id"] < 4} == {1: None, 2: 1, 3: None}
    none = merging.merge(before, pointers.limit(0), MOVES, flags="flags")
    assert none[1].count() == 0 and all(rows_of(none[0][n]) == rows_of(before[n]) for n in before)


def test_merges_look_no_row_up_by_its_id(spark, monkeypatch):
    before = tables(spark)
    pointers = spark.createDataFrame([(2, 1), (3, 2), (7, 8)], "gone long, keep long")
    got = []
    for most in (merging.BROADCAST, 0):
        monkeypatch.setattr(merging, "BROADCAST", most)
        after, journal = merging.merge(before, pointers, MOVES, flags="flags")
        assert not [n for n, df in after.items() if "row_id" in df._jdf.queryExecution().optimizedPlan().toString()]
        got.append(({n: rows_of(df) for n, df in after.items()}, rows_of(journal)))
        assert all(rows_of(merging.undo(after, journal, IDS)[n]) == rows_of(before[n]) for n in before)
    assert got[0] == got[1] and len(got[0][1]) > 10 and ("d", 7, 8, "dismissed") in got[0][0]["flags"]


def test_changed_rows_are_told_with_their_ids_shuffled_once(spark):
    x = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "id string, n int")
    y = spark.createDataFrame([("a", 1), ("b", 3), ("d", None)], "id string, n int")
    found = merging.changed_rows(x, y, "id")
    assert found.first()["changed"] == 4 and "named_struct(id" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert merging.changed_rows(x.select("id"), y.select("id"), "id").first()["changed"] == 2


def test_kept_is_the_record_with_more_readings_then_the_older(spark):
    r = spark.createDataFrame([(1, 3, 5, "M"), (2, 3, 4, "M"), (3, 9, 9, "M"), (4, None, 1, "F"), (5, None, 1, "M")], "k long, n long, created long, sex string")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (5, 1), (5, 5)], "a long, b long")
    assert rows_of(merging.choose_kept(pairs, r, "k", "n", "created", ["sex"])) == [(1, 2), (2, 3), (5, 1)]
