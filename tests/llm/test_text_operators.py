"""Mixing, line templates, chat, decontamination, pseudonyms and quality: SQL twins, brute force, edges."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.llm import chat, decontaminate as D, line_templates as L, mixing as M, pseudonyms as P, quality as Q
from tracewell.llm.queries import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x") for i, t, s in rows], DOCS)


@pytest.mark.parametrize("name", [n for n in sorted(ORACLE) if not n.startswith(("op2", "pipeline"))])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    got, want = QUERIES[name](spark, DIR).toPandas(), con.execute(ORACLE[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a, b = (x[cols].convert_dtypes().astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


def test_mix_follows_targets(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "b", None, "c", "ü"])) for i in range(400)] + [(7, None, "a"), (7, "w w", "a"), (None, "w", "zz")]
    got = M.mix_sources(docs(spark, *rows)).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by = {}
    size, taken = sum(r["size"] for r in got), sum(r["taken"] for r in got)
    for r in got:
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(v) - t) <= 12 for (_, t), v in by.items()) and abs(taken - size) <= 8 * len(by)
    again = M.mix_sources(docs(spark, *reversed(rows)).repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert M.mix_sources(docs(spark, (1, "a", "a")).limit(0)).count() == 0
    assert M.mix_sources(docs(spark, (1, None, "a"), (2, "", None))).first()["taken"] == 0


def test_targets_by_resharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 500, "e": 1, "f": 2000}
    got = {r["source"]: r["target"] for r in M.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), [5, 2, 1], 3).collect()}
    w = dict(zip(sorted(sizes), [5, 2, 1, 5, 2, 1]))
    total, want, open_ = sum(sizes.values()), {}, set(sizes)
    while True:
        left = total - sum(want.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            want |= share
            break
        want |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    assert all(math.isclose(got[s], want[s]) for s in sizes)


def test_sainte_lague_gives_highest_quotients(spark):
    votes = {f"p{i}": v for i, v in enumerate([340, 280, 160, 60, 7, 1, 152])}
    df = spark.createDataFrame([("g", p, v, 23) for p, v in votes.items()] + [("h", "z", 0, 5)], "g string, p string, v long, s long")
    got = {r["p"]: r["quota"] for r in M.sainte_lague(df, "g", "p", "v", "s").collect()}
    want = dict.fromkeys(votes, 0)
    for _ in range(23):
        want[max(sorted(votes), key=lambda p: votes[p] / (2 * want[p] + 1))] += 1
    assert got == want | {"z": 0}


def test_lines(spark):
    footer = "Page {} of 17, printed for you by the office"
    named = "Many thanks to {} for reading this page to the very end"
    rows = [(i, f"own words number {'abcdefgh'[i]} here\n{footer.format(i)}\n\n{named.format('abcdefgh'[i] * 3)}\nAnd.", "s") for i in range(6)]
    df = docs(spark, *rows, (9, None, "s"), (10, "", "s"), (None, footer.format(9), "s"))
    out = {r["doc_id"]: r for r in L.drop_recurring_lines(df).collect()}
    assert out[0]["text"] == rows[0][1] and out[9]["text"] is None and out[10]["text"] == "" and out[None]["text"] == ""
    for i in range(1, 6):
        assert out[i]["text"] == f"own words number {'abcdefgh'[i]} here\n\nAnd." and out[i]["n_chars"] == len(out[i]["text"])
    assert L.drop_recurring_lines(df).columns == df.columns and L.drop_recurring_lines(df.limit(0)).count() == 0


def test_a_stray_line_hides_no_template(spark):
    """Variants that each differ in another part, and one line of the same leaf that has nothing in common with them."""
    line = lambda words: " ".join(["one", "two", "three", *words])
    base = [f"w{c}" for c in "abcdefghijklmnopqrst"]
    variants = [line(w if i != at else "other" for i, w in enumerate(base)) for at in (1, 7, 12, 18, 99)]
    stray = line(f"z{c}" for c in "abcdefghijklmnopqrst")
    df = docs(spark, *[(i, t, "s") for i, t in enumerate(variants + [stray])])
    out = {r["doc_id"]: r["text"] for r in L.drop_recurring_lines(df).collect()}
    assert [out[i] for i in range(6)] == [variants[0], "", "", "", "", stray]


def test_figures_stay(spark):
    """Rows of numbers have no constant word, nor have templates whose words all lie in the variable parts."""
    texts = ["1 2 3", "9 9 9", "55 1 0", "| 12 | 40 |", "| 7 | 8 |", "| 1 | 1 |", "- - - -", "- - - -", "- - - -"]
    texts += [f"{i} {i + 1} {i + 2} word{'abc'[i]} {i} {i} {i} {i} {i} {i} {i} {i}" for i in range(3)]
    texts += [f"Total of row {i} is {i * 7}" for i in range(3)]
    out = {r["doc_id"]: r["text"] for r in L.drop_recurring_lines(docs(spark, *[(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert [out[i] for i in range(6)] == texts[:6] and [out[i] for i in range(9, 12)] == texts[9:12]
    assert [out[i] for i in range(6, 9)] == ["- - - -", "", ""] and [out[i] for i in range(12, 15)] == [texts[12], "", ""]


def test_lines_dropped_in_error(spark):
    """Lines that differ by construction, in words and figures alike: none may go."""
    rng = random.Random(12)
    vocab = [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{i:x}".translate({ord(c): "ghijklmnop"[int(c)] for c in "0123456789"}) for i in range(3000)]
    line = lambda: " ".join(str(rng.randrange(999)) if rng.random() < 0.1 else rng.choice(vocab) for _ in range(rng.randrange(3, 30)))
    df = docs(spark, *[(i, "\n".join(line() for _ in range(50)), "s") for i in range(400)])
    assert L._without(df, "doc_id", "text", "n_chars", 3, 2)[1].agg(F.sum("n_dropped")).first()[0] == 0


def test_many_lines_in_one_document(spark):
    """Positions are matched in linear time: a text of 200,000 recurring lines takes seconds."""
    import time

    lines = "\n".join(f"line number x{'abcdefghij'[i % 10]}y{'abcdefghij'[i // 10 % 10]}z of this document" for i in range(200_000))
    df = docs(spark, *[(i, lines + f"\nown {'abc'[i]} words here", "s") for i in range(3)]).repartition(3)
    began = time.time()
    out = {r["doc_id"]: r["text"] for r in L.drop_recurring_lines(df).collect()}
    assert time.time() - began < 60
    assert [out[i] for i in (1, 2)] == ["own b words here", "own c words here"] and len(out[0].split("\n")) == 101


def test_a_document_that_holds_the_benchmark(spark):
    """Time in proportion to the items, and each found where it stands."""
    import time

    rng = random.Random(6)
    items = [(i, " ".join(f"q{rng.randrange(10**6)}" for _ in range(30))) for i in range(1600)]
    took = {}
    for n in (100, 400, 1600):
        text = " ".join(t for _, t in items[:n])
        began = time.time()
        got = D.find_passages(docs(spark, (1, text, "s")), spark.createDataFrame(items[:n], "item_id long, text string")).collect()
        took[n] = time.time() - began
        assert {(r["item"], r["start"], r["end"], r["distance"]) for r in got} == {(i, 30 * i, 30 * i + 30, 0) for i in range(n)}
    assert took[1600] < 40


def test_places_apart():
    assert D.apart([(0, 30, 2), (5, 30, 1), (30, 60, 0), (31, 60, 0), (90, 99, 3)]) == [(5, 30, 1), (30, 60, 0), (90, 99, 3)]


CLASH = ["row", "id", "own", "its", "goes", "n_lines", "n_dropped", "its_id", "its_row", "taken", "kept", "_row", "_id", "_kept", "_goes", "_t", "h", "text_", "block"]


def test_stages_keep_clashing_columns(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    plain = spark.read.parquet(f"{d}/documents.parquet").limit(60)
    rows = plain.collect()
    plain = spark.createDataFrame(rows + rows[:2] + [(None, rows[5]["text"], "en", "src1", 5), (9001, None, None, None, None), (9002, "", "en", None, 0)], plain.schema)
    wide = plain.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])
    for name, stage in corpus_pipeline.STAGES:
        a, b = stage(spark, plain, d), stage(spark, wide, d)
        assert b.columns[: len(wide.columns)] == wide.columns, name
        assert sorted(map(str, a.select(*plain.columns).collect())) == sorted(map(str, b.select(*plain.columns).collect())), name
        assert b.select(*CLASH).distinct().collect() == [tuple(range(len(CLASH)))], name


def test_chat_edges(spark):
    rows = [(1, 0, "u", "a"), (2, 0, "u", "a"), (2, 1, "s", "b"), (3, 0, "u", "a"), (3, 1, "s", "b"), (4, 0, "u", None), (5, 0, "u", ""), (None, 0, None, "q"), (6, 3, "u", "a"), (6, 5, "s", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: (r["n_turns"], r["rendered"]) for r in chat.format_conversations(df, "<", ":", ">").collect()}
    assert out == {2: (2, "<u:a><s:b>"), 4: (1, "<u:>"), 5: (1, "<u:>"), None: (1, "<:q>"), 6: (2, "<u:a><s:c>")}
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_passages(spark):
    rng = random.Random(4)
    vocab = [f"v{int(rng.paretovariate(0.8))}" for _ in range(3000)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([6, 9, 14, 20, 33, 60, 150, 400, 3])] + [(99, None), (98, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, want = [], set()
    for i, t in items[:8]:
        for c in range(3):
            w = t.split()
            if c == 1 and len(w) >= 10:
                w[len(w) // 2] = "changed"
            if c == 2:
                w = [x.upper() for x in w]
            rows.append((100 * i + c, " ".join(words(30) + w + words(30)), "s"))
            if not (c == 1 and len(w) < 10):
                want.add((100 * i + c, i))
    rows += [(5000 + i, " ".join(words(200)), "s") for i in range(40)] + [(6000, None, "s"), (6001, "", "s"), (None, items[4][1], "s")]
    got = D.find_passages(docs(spark, *rows), bench).collect()
    found = {(r["id"], r["item"]) for r in got if r["id"] is not None}
    assert want <= found and not any(i >= 5000 and item != 8 for i, item in found) and any(r["id"] is None for r in got)
    texts = {i: t for i, t, _ in rows}
    for r in got:  # what is reported is there
        piece = texts[r["id"]].lower().split()[r["start"] : r["end"]]
        assert edits(part_of(items[r["item"]][1].split(), r["part"]), piece) == r["distance"]
    assert D.find_passages(docs(spark, *rows), bench.limit(0)).count() == 0
    assert D.find_passages(docs(spark, *rows).limit(0), bench).count() == 0


def part_of(words, part):
    cuts = np.linspace(0, len(words), max(1, -(-len(words) // D.LONGEST)) + 1).astype(int)
    return words[cuts[part] : cuts[part + 1]]


def edits(a, b):
    """The edit distance, by the whole matrix."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


def test_best_match_against_all_parts():
    rng = random.Random(3)
    for _ in range(300):
        item, text = ([rng.choice("abc") for _ in range(n)] for n in (rng.randint(1, 9), rng.randint(0, 14)))
        every = [(edits(item, text[s:e]), e, -s) for e in range(len(text) + 1) for s in range(e + 1)]
        d, s, e = D.best_match(item, text)
        assert d == min(every)[0] and (d == len(item) or (d, e, -s) == min(x for x in every if x[1] > 0))


def test_passages_against_all_windows(spark, monkeypatch):
    """Every place within a tenth of edits, by brute force over all windows; items of 1 to 40 words."""
    rng = random.Random(11)
    vocab = [f"u{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 8, 12, 20, 30, 40])]
    rows = []
    for k in range(60):
        w = [rng.choice(vocab) for _ in range(60)]
        at = rng.randint(0, 60)
        own = items[k % 10][1].split()
        if len(own) >= 20 and k % 3:
            own[rng.randrange(len(own))] = "other"
        rows.append((k, " ".join(w[:at] + own + w[at:]), "s"))
    rows += [(100, items[7][1] + " x y z " + items[7][1], "s"), (100, items[7][1] + " x y z " + items[7][1], "s")]
    bench = spark.createDataFrame(items + [(50, items[7][1])], "item_id long, text string")
    want = set()
    for i, t, _ in rows:
        w = t.split()
        for item, body in items:
            b = body.split()
            most = int(D.EDITS * len(b))
            for s in range(len(w)):
                for e in range(max(s + 1, s + len(b) - most), min(len(w), s + len(b) + most) + 1):
                    if (most or w[s:e] == b) and edits(b, w[s:e]) <= most:
                        want.add((i, item, s // 1000 if most else s))
    for most_hashes in (1 << 21, 40):  # in one round and in many
        monkeypatch.setattr(D, "MOST_HASHES", most_hashes)
        got = D.find_passages(docs(spark, *rows), bench).collect()
        assert {(r["id"], r["item"], r["start"] // 1000 if D.EDITS * len(items[r["item"] % 43][1].split()) >= 1 else r["start"]) for r in got if r["item"] < 50} == want
        assert {(r["start"], r["end"], r["distance"]) for r in got if r["id"] == 100 and r["item"] in (7, 50)} == {(0, 20, 0), (23, 43, 0)}
        assert sum(r["id"] == 100 and r["item"] == 50 for r in got) == 2


def test_lsh_recall():
    """Recall at a tenth of edits for items up to 200 words; those above LONGEST are found by any part."""
    rng = np.random.default_rng(5)
    vocab = rng.integers(1, 2**62, 3000).astype(np.uint64) | np.uint64(1)
    p = 1 / np.arange(1, 3001)
    p /= p.sum()
    for size in (15, 20, 30, 40, 48, 60, 80, 96, 107, 200):
        hit = 0
        for _ in range(60):
            item = rng.choice(vocab, size, p=p)
            w = list(item)
            for _ in range(size // 10):
                i, kind = rng.integers(len(w)), rng.integers(3)
                if kind == 0:
                    w[i] = rng.choice(vocab)
                elif kind == 1:
                    w.insert(i, rng.choice(vocab))
                else:
                    w.pop(i)
            around = list(rng.choice(vocab, 30, p=p))
            seq = np.array(around + w + around + [0], np.uint64)
            start, found = np.arange(len(seq) - 1), False
            for part in range(max(1, -(-size // D.LONGEST))):
                own = part_of(item, part)
                c = D.size_class(len(own))
                a = {h[0] for _, h, _ in D.signatures(np.append(own, np.uint64(0)), np.zeros(1, np.int64), [c])}
                near = any(not a.isdisjoint(h.tolist()) for _, h, _ in D.signatures(seq, start, [c]))
                found |= near and bool(D.matches(own.tolist(), seq[:-1].tolist(), D.EDITS * len(own)))
            hit += found
        assert hit / 60 >= 0.95, (size, hit)


def feistel(key, domain, a, b, ma, mb):
    for r in range(P.ROUNDS):
        x = b if r % 2 == 0 else a
        f = int(hashlib.sha256(f"{key}:{domain}:{r}:{x}".encode()).hexdigest()[:12], 16)
        if r % 2 == 0:
            a = (a + f) % ma
        else:
            b = (b + f) % mb
    return a, b


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def test_pseudonyms(spark):
    text = "call +1 (544) 555-8128 or 4111 1111 1111 1111, 2024-02-29 02/28/1999 1899-12-31 10.0.0.1 300.1.1.1 a.b+c@ex.com 123-45-6789 4111111111111112 é"
    df = docs(spark, (1, text, "s"), (2, "x 4111111111111111", "s"), (3, None, "s"), (None, "", "s"), (4, "plain " * 20000, "s"))
    out = {r["doc_id"]: r for r in P.pseudonymise(df, "k'\\").collect()}
    t = out[1]["text"]
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", t)[0].replace(" ", "")
    assert luhn(card) and card != "4" + "1" * 15 and out[2]["text"] == f"x {card}"
    a, b = feistel("k'\\", "card", 4111111, 11111111, 10**7, 10**8)
    assert card[:15] == f"{a:07d}{b:08d}"
    a, b = feistel("k'\\", "social", 1234, 56789, 10**4, 10**5)
    n = f"{a:04d}{b:05d}"
    assert f"{n[:3]}-{n[3:5]}-{n[5:]}" in t
    assert "1899-12-31" in t and "300.1.1.1" in t and "4111111111111112" in t and "@ex.com" in t and t.endswith(" é")
    assert re.sub(r"[a-z]+(?=@)", "", re.sub(r"\d", "9", t))[:40] == re.sub(r"\d", "9", text)[:40]
    assert out[3]["text"] is None and out[None]["text"] == "" and out[4]["text"] == "plain " * 20000
    assert [out[1][f"n_{k}"] for k in ("card", "phone", "social", "date", "address", "mail")] == [1, 1, 1, 2, 1, 1]
    kinds = tuple(k for k in P.PATTERNS if k != "mail")
    there = P.pseudonymise(df, "s", kinds=kinds)
    back = {r["doc_id"]: r["text"] for r in P.pseudonymise(there, "s", kinds=kinds, back=True).collect()}
    assert back == {r["doc_id"]: r["text"] for r in df.collect()}


def test_more_forms_of_phones_dates_and_social_numbers(spark):
    text = "(743) 555-3824, 743-555-3824 743.555.3824 +1 (743) 555-3824; 31.12.1999 29.02.1900 000-00-0000 666-12-3456 901-11-1111 123-00-4567 078-05-1120 31.12.1999.7 1-743-555-3824-9"
    rows = [(1, text, "s"), (2, "4111 1111 1111 1111 743-555-3824", "s")] + [(100 + i, f"{1 + i % 899:03d}-{1 + i % 99:02d}-{1 + i:04d}", "s") for i in range(300) if 1 + i % 899 != 666]
    df = docs(spark, *rows)
    kinds = tuple(k for k in P.PATTERNS if k != "mail")
    there = P.pseudonymise(df, "k", kinds=kinds)
    got = {r["doc_id"]: r for r in there.collect()}
    t = got[1]["text"]
    digits = {re.sub("[^0-9]", "", x)[-10:] for x in re.findall(r"(?:\+1 )?\(?\d{3}\)?[ .-]\d{3}[.-]\d{4}", t.split(";")[0])}
    assert len(digits) == 1 and digits != {"7435553824"} and got[1]["n_phone"] == 4
    a, b = feistel("k", "phone", 74355, 53824, 10**5, 10**5)
    assert digits == {f"{a:05d}{b:05d}"}
    assert re.search(r" \d\d\.\d\d\.\d{4} 29\.02\.1900 000-00-0000 666-12-3456 901-11-1111 123-00-4567 ", t) and "31.12.1999 " not in t
    assert "078-05-1120" not in t and t.endswith("31.12.1999.7 1-743-555-3824-9") and got[1]["n_social"] == 1 and got[1]["n_date"] == 1
    assert got[2]["n_card"] == got[2]["n_phone"] == 1
    new = [got[i]["text"] for i, _, _ in rows[2:]]
    assert len(set(new)) == len(new) and not any(x[:3] in ("000", "666") or x[0] == "9" or x[4:6] == "00" or x[7:] == "0000" for x in new)
    back = {r["doc_id"]: r["text"] for r in P.pseudonymise(there, "k", kinds=kinds, back=True).collect()}
    assert back == {i: x for i, x, _ in rows}
    assert P.pseudonymise(df.limit(0), "k").count() == 0


def test_cards_among_other_digits(spark):
    card, other = "4111 1111 1111 1111", "5500-0000-0000-0004"
    around = ["{} 123", "7 {}", "12 {} 123", "1234567 {}", "{} 2024-02-29", "{} 10.0.0.1", "5 {} 02/28/1999", "{} 123-45-6789", "{} 55-x", "{} 9876 {}", "{},"]
    rows = [(i, a.replace("{}", c), "s") for i, (a, c) in enumerate((a, c) for a in around for c in (card, other))]
    rows += [(500 + i, f"{i} {card} {i * 37 % 1000:03d}", "s") for i in range(100)] + [(900, "12 2024-02-29 12345", "s"), (901, "8 " * 6000, "s")]
    df = docs(spark, *rows)
    kinds = tuple(k for k in P.PATTERNS if k != "mail")
    there = P.pseudonymise(df, "s", kinds=kinds)
    got = {r["doc_id"]: r for r in there.collect()}
    for i, _, _ in rows[:-2]:
        assert card not in got[i]["text"] and other not in got[i]["text"] and got[i]["n_card"] >= 1
    assert got[18]["n_card"] == 2
    assert all(got[i][f"n_{k}"] == 1 for i, k in ((8, "date"), (10, "address"), (12, "date"), (14, "social"), (900, "date")))
    back = {r["doc_id"]: r["text"] for r in P.pseudonymise(there.filter("doc_id < 901"), "s", kinds=kinds, back=True).collect()}
    assert back == {i: t for i, t, _ in rows if i < 901}


def kneser_ney(texts, k=Q.ORDER):
    """Counts and probabilities by dictionaries."""
    from collections import Counter

    counts = {k: Counter(g for t in texts for g in (("\x02" * (k - 1) + t)[i : i + k] for i in range(len(t))))}
    for o in range(k - 1, 0, -1):
        counts[o] = Counter(g[1:] for g in counts[o + 1])
    off = {}
    for o, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        if all(n[:3]):
            y = n[0] / (n[0] + 2 * n[1])
            d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
            off[o] = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]
        else:
            off[o] = [0.5] * 3

    def p(g):
        o = len(g)
        below = p(g[1:]) if o > 1 else 1 / (1 << Q.BITS)
        same = [v for h, v in counts[o].items() if h[:-1] == g[:-1]]
        if not same:
            return below
        d = lambda v: off[o][min(v, 3) - 1] if v else 0.0
        c = counts[o].get(g, 0)
        return (c - d(c)) / sum(same) + sum(map(d, same)) / sum(same) * below

    return p


def test_perplexity_against_dictionaries(spark, monkeypatch):
    train = ["the cat sat on the mat", "a cat and a rat", "that hat", "", "mat"]
    ask = ["the rat sat", "", None, "ZZ é", "cat", "\U0010ffff\x00 中文 cat", "the cat the cat the cat " * 30, "a" + "b" * 300 + "a"]
    train += ["中文字符", "\x00\U0010ffff"]
    df = docs(spark, *[(i, t, "s") for i, t in enumerate(ask)])
    monkeypatch.setattr(Q, "STEP", 7)  # so that texts are cut in many pieces
    known = Q.model(Q.count_tables(docs(spark, *[(i, t, "s") for i, t in enumerate(train)])))
    got = {r["id"]: r for r in Q.perplexities(df, known).collect()}
    p = kneser_ney(train)
    for i, t in enumerate(ask):
        t = t or ""
        padded = "\x02" * (Q.ORDER - 1) + t
        cost = [-math.log(p(padded[j : j + Q.ORDER])) for j in range(len(t))]
        assert got[i]["n"] == len(t) and math.isclose(got[i]["cost"], sum(cost), rel_tol=1e-4, abs_tol=1e-9)


def test_near_repeats_cost_nothing():
    text = "abcdefgh" * 3 + "x" * 300 + "abcdefgh"
    rows = pa.table({"id": [1, 2], "row": [5, 6], "lang": ["en", "en"], "text": ["abcdefgh", text]})
    got = Q._Block([]).score(rows, pa.int64(), pa.string()).to_pylist()
    padded, last, new = "\x02" * (Q.ORDER - 1) + text, {}, 0
    for j in range(len(text)):
        g = padded[j : j + Q.ORDER]
        new += j - last.get(g, -math.inf) > Q.NEAR
        last[g] = j
    assert math.isclose(got[1]["fresh"], new * Q.BITS * math.log(2)) and math.isclose(got[1]["cost"], len(text) * Q.BITS * math.log(2))
    assert got[0]["fresh"] == got[0]["cost"]  # the other text's n-grams don't count


def test_quality_edges(spark):
    df = docs(spark, (1, "some text", "s"), (2, None, "s"), (None, "x", "s"))
    none = spark.createDataFrame([], "doc_id long")
    assert all(r["keep"] for r in Q.classify_quality(df, none).collect())
    assert Q.classify_quality(df.limit(0), none).count() == 0


def test_quality_separates(spark):
    d = "/root/testdata/sf0.01"
    got = Q.op8_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good = [r["keep"] for r in got if r["quality"]]
    bad = [r["keep"] for r in got if not r["quality"]]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.05


def test_quality_limits_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs_, ids = spark.read.parquet(f"{d}/documents.parquet"), Q.trusted(spark, d)
    rows = Q.classify_quality(docs_, ids).collect()
    half = {r[0]: r[1] for r in ids.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2))).collect()}
    for lang in {r["lang"] for r in rows}:
        own = [r for r in rows if r["lang"] == lang and r["n"]]
        held = [r for r in own if half.get(r["doc_id"]) == 1]
        at = lambda values, q: sorted(values)[max(0, math.ceil(q * len(values) - 1e-9) - 1)]
        middle, part = (at([r[c] for r in held], 0.5) if held else 0 for c in ("perplexity", "fresh_share"))
        prior = Q.PRIOR * math.log(middle) if held else 0
        drawn = lambda r: math.exp((r["n"] * math.log(r["perplexity"]) + prior) / (r["n"] + Q.PRIOR))  # noqa: B023, E731
        share = lambda r: (r["fresh_share"] * (c := r["n"] * math.log(r["perplexity"])) + prior * part) / (c + prior)  # noqa: B023, E731
        most = at(list(map(drawn, held)), 0.995) * 1.05 if held else math.inf
        least = at(list(map(share, held)), 0.005) / 1.05 if held else 0
        for r in own:
            assert not held or math.isclose(r["most"], most, rel_tol=0.005) and math.isclose(r["least"], least, rel_tol=0.005)
            high, low = drawn(r) / most, share(r) / least if least else 9
            if abs(high - 1) > 0.005 and abs(low - 1) > 0.005:
                assert r["keep"] == (high < 1 < low)
