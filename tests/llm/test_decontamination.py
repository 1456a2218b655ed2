from __future__ import annotations

import random
import re

from dossier.llm import decontamination


def distances(item, text):
    """Edit distance of ``item`` to the best stretch of ``text`` that ends at each word."""
    column, out = list(range(len(item) + 1)), []
    for word in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(column[i] + (x != word), column[i + 1] + 1, new[i] + 1))
        column = new
        out.append(column[-1])
    return out


def test_myers_equals_dynamic_programming():
    rnd = random.Random(1)
    for _ in range(400):
        item = [rnd.randrange(4) for _ in range(rnd.randint(1, 70))]
        text = [rnd.randrange(4) for _ in range(rnd.randint(0, 80))]
        budget, found = rnd.randint(0, 30), distances(item, text)
        best = min(found, default=99)
        assert decontamination.myers(item, text, budget) == ((best, found.index(best)) if best <= budget and found else None)


def _normal(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def brute(docs, items, short=True):
    """(distance, first word, last word) of the best stretch of each document for each item, the first, then the shortest."""
    out = {}
    for d, text in docs:
        words = _normal(text)
        for i, item in items:
            wanted = _normal(item)
            budget = len(wanted) // decontamination.WORDS_PER_ERROR
            if not wanted or not words or not (budget or short or wanted == words):
                continue
            found = distances(wanted, words)
            best = min(found)
            if best <= budget:
                end = found.index(best)
                starts = range(end, max(-1, end - len(wanted) - best), -1)
                out[d, i] = best, next(s for s in starts if edits(wanted, words[s : end + 1]) == best), end
    return out


def test_leaks_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(2)
    prose = lambda n: [rnd.choice("abcdefghij") + str(rnd.randint(0, 9)) for _ in range(n)]
    items = [(i, prose(n)) for i, n in enumerate((1, 3, 4, 5, 6, 9, 10, 14, 20, 33, 64, 65, 90))]
    docs = []
    for k in range(200):
        words = prose(rnd.choice([0, 5, 40, 200]))
        for _ in range(rnd.randint(0, 2)):
            part = list(rnd.choice(items)[1])
            for _ in range(rnd.randint(0, max(1, len(part) // 4))):
                kind, at = rnd.random(), rnd.randrange(len(part) + 1)
                if kind < 0.4 and at < len(part):
                    part[at] = "new"
                elif kind < 0.7:
                    part.insert(at, "more")
                elif at < len(part):
                    del part[at]
            at = rnd.randint(0, len(words))
            words[at:at] = part
        docs.append((k, rnd.choice([" ", ", ", "\n- "]).join(words).upper()))
    items = [(i, " ".join(x).capitalize() + ".") for i, x in items] + [(100, ""), (101, None), (7, "..."), (102, items[8][1] and " ".join(items[8][1]))]
    docs += [(300, items[1][1]), (301, "x " + items[1][1]), (302, None), (303, ""), (304, ("filler " * 20_000) + items[12][1])]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, leaks string, item_id int").repartition(4)
    table = spark.createDataFrame(items, "item_id long, text string")
    for size, short in ((decontamination.BLOCK_BYTES, True), (400, False)):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", size)
        got = {}
        for r in decontamination.with_leaks(frame.drop("leaks", "item_id"), table, short=short).selectExpr("doc_id", "inline(leaks)").collect():
            key, leak = (r["doc_id"], r["item_id"]), (r["distance"], r["first_word"], r["last_word"])
            if key not in got or (leak[0], leak[2]) < (got[key][0], got[key][2]):
                got[key] = leak
        assert got == brute(docs, items, short) and len(got) > 100


def test_ends_of_leaks_and_neighbours(spark):
    item = [f"w{i}" for i in range(15)]
    cases = [
        (["a", "b", *item[:4], "x", *item[4:9], "y", *item[9:]], (2, 2, 18)), (["a", *item[:5], *item[6:9], *item[10:]], (2, 1, 13)),
        (item[2:], (2, 0, 12)), (["a", "b", "c", *item], (0, 3, 17)),
    ]
    rows = [(k, " ".join(words)) for k, (words, _) in enumerate(cases)] + [(9, " ".join([*item, "and", *item, *item]))]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = [(r["doc_id"], (r["distance"], r["first_word"], r["last_word"])) for r in decontamination.leaks(docs, items).collect()]
    assert sorted(g for g in got if g[0] < 9) == [(k, want) for k, (_, want) in enumerate(cases)]
    # an item that follows itself is told three times
    assert sorted(leak for d, leak in got if d == 9) == [(0, 0, 14), (0, 16, 30), (0, 31, 45)]


def test_rows_and_columns_are_kept(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, item, "x"), (1, item, "x"), (None, "so " + item, None), (2, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leaks string")
    items = spark.createDataFrame([(5, item)], "item_id long, text string")
    got = decontamination.with_leaks(docs, items, "found")
    assert got.columns == [*docs.columns, "found"]
    assert sorted((str(r["doc_id"]), [tuple(x) for x in r["found"]]) for r in got.collect()) == [("1", [(5, 0, 0, 9)]), ("1", [(5, 0, 0, 9)]), ("2", []), ("None", [(5, 0, 1, 10)])]
    assert decontamination.leaks(docs.limit(0), items).count() == 0 and decontamination.leaks(docs, items.limit(0)).count() == 0


def test_items_in_scripts_without_spaces(spark):
    item = "石头被水慢慢磨圆了,所以河里的石头都很光滑"
    edited = item.replace("慢慢", "渐渐")
    docs = [
        (1, f"开头的话 {item} 后面的话"), (2, f"some words before这里说{edited}。and after"), (3, item), (4, "石头被水磨,河里都很"),
        (5, "short 石头 here"), (6, "石头"), (7, "no such text"), (8, None), (9, f"x {item.replace('石头', '木头').replace('光滑', '粗糙')} y"),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(1, item), (2, "石头"), (3, "ก้อนหินในแม่น้ำเรียบและกลม")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"], r["first_word"], r["last_word"]) for r in decontamination.leaks(frame, items).collect()}
    assert got == {(1, 1, 0, 1, 2), (2, 1, 2, 2, 3), (3, 1, 0, 0, 1), (5, 2, 0, 1, 1), (6, 2, 0, 0, 0)}
