"""Exact search, conversation repair and phrases against brute force and SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from signalcheck.llm import double_array, phrases, repair, topk
from signalcheck.llm.queries import ORACLE, QUERIES
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_sql(spark, folder, name):
    assert compare(QUERIES[name](spark, folder), connect(folder), ORACLE[name]) is None


def test_trie_holds_its_keys_and_no_others():
    rng = np.random.default_rng(1)
    keys = sorted({bytes(rng.integers(0, 256, rng.integers(1, 6))) for _ in range(5_000)} | {bytes([i]) for i in range(256)})
    trie = double_array.of_texts(keys)

    def find(word):
        state = np.zeros(1, np.int64)
        for symbol in word:
            state, found = trie.step(state, np.array([symbol]))
            if not found[0]:
                return -1
        return trie.value[state[0]]

    assert [find(k) for k in keys] == list(range(len(keys)))
    others = {bytes(rng.integers(0, 256, 4)) for _ in range(2_000)} - set(keys)
    assert all(find(k) == -1 for k in others)


# --- exact search


def brute_top(rows, k=5, every=50):
    whole = []
    for at, (vec_id, vector) in enumerate(rows):
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            whole.append((at, vec_id, [math.floor(256 * x) for x in vector]))
    out = []
    for at, query_id, q in whole:
        if query_id is None or query_id % every:
            continue
        found = sorted(
            (-sum(a * b for a, b in zip(q, v, strict=True)), vec_id is None, vec_id or 0) for other, vec_id, v in whole if other != at and len(v) == len(q)
        )
        out += [(query_id, rank, None if none else vec_id, -score) for rank, (score, none, vec_id) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def ran(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def test_top_k_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "TREE_ENTRIES", 40)
    monkeypatch.setattr(topk, "BLOCK", 3)
    monkeypatch.setattr(topk, "PAGE", 20)
    monkeypatch.setattr(topk, "REGIONS", 4)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4) * 10.0 ** rng.integers(-2, 3)]) for i in range(700)]
    rows += [(5_000 + i, [0.5, 0.25, 0.0, -1.0]) for i in range(400)]  # one very common vector, ties by id
    rows += [(i, [0.0, 0.0, 0.0, 0.0]) for i in (9_000, 9_001, 9_050)]
    rows += [(50, [1.0, 2.0, 3.0, 4.0]), (50, [1.0, 2.0, 3.0, 4.0]), (None, [1.0, 2.0, 3.0, 4.0]), (None, None), (100, None)]
    rows += [(150, [1.0, None, 0.0, 0.0]), (200, [math.nan, 1.0, 1.0, 1.0]), (250, [math.inf, 1.0, 1.0, 1.0]), (300, []), (350, []), (400, [1.0, 2.0]), (-50, [3.0, 1.0])]
    df = spark.createDataFrame([(a, b, 1, 2, "x") for a, b in rows], "vec_id long, embedding array<double>, row int, size int, entry string").repartition(5)
    assert ran(topk.top_k(df)) == brute_top(rows)


def test_top_k_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert ran(topk.top_k(spark.createDataFrame([], schema))) == []
    assert ran(topk.top_k(spark.createDataFrame([(0, [1.0])], schema))) == []
    assert ran(topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema))) == [(0, 1, 1, 131072)]


def test_tree_leaves_out_distances():
    rng = np.random.default_rng(2)
    centres = rng.integers(-2_000, 2_000, (20, 8))
    vectors = (centres[rng.integers(0, 20, 5_000)] + rng.integers(-20, 20, (5_000, 8))).astype(np.int64)
    tree = topk.Tree(vectors)
    found, compared = tree.search(vectors[0], 5, np.ones(5_000, int), -(2**62))
    best = np.sort(vectors @ vectors[0])[::-1][:5]
    assert sorted((s for s, _ in found), reverse=True)[:5] == best.tolist()
    assert compared < 1_500


# --- conversation repair


def brute_repair(rows):
    kept = defaultdict(list)
    for conv, turn, role, text in rows:
        kept[conv]
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, said in kept.items():
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in said:
            told = text.strip(" \t\n\x0b\x0c\r")
            faults.append("b" if not told else "d" if (role, text) in seen else "t" if told[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in said if t is not None}
        initials = [r[:1] for _, r, _ in said]
        best = {0: (0, "", ())}

        def spread(best):
            for _ in range(3):
                for s, (cost, audit, told) in list(best.items()):
                    to = 3 if s == 2 else 2
                    new = (cost + 2, audit + "I", told + (("user:" if to == 2 else "assistant:"),))
                    best[to] = min(best.get(to, new), new)

        spread(best)
        for (_, role, text), fault in zip(said, faults, strict=True):
            new = {}

            def put(s, value):
                new[s] = min(new.get(s, value), value)  # noqa: B023

            for s, (cost, audit, told) in best.items():
                put(s, (cost + 3, audit + "D", told))
                if fault in "bd" and fault:
                    continue
                late = fault == "t"
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], s))
                if to is not None:
                    put(to, (cost + late, audit + "K", told + (f"{role}:{text}",)))
                to = 3 if s == 2 else 2
                put(to, (cost + 2 + late, audit + "R", told + (("user:" if to == 2 else "assistant:") + text,)))
            spread(new)
            best = new
        cost, audit, told = min(best[s] for s in (0, 3) if s in best)
        out.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(told).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment", [2, 7, 3_072])
def test_repair_of_odd_conversations(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rng = random.Random(segment)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ua"]
    texts = ["Hi.", "Yes!", "no end", "", "  \t", None, "Why?", "a.b", "Same.", "Same.", "end. \n"]
    rows = [
        (rng.choice([*range(60), None]) if i < 600 else 777, rng.choice([*range(12), None]) if i < 600 else i, rng.choice(roles), rng.choice(texts))
        for i in range(900)
    ]
    rows += [(5, 0, "user", "long " * 50_000 + ".")] * 2
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, conv string, pos int, symbol int").repartition(6)
    found = repair.repair(df)
    names = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    assert sorted(map(tuple, found.select(names).collect()), key=repr) == brute_repair(rows)
    sql = duckdb.connect()
    frame = df.toPandas()  # noqa: F841
    sql.execute("CREATE TABLE conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM frame WHERE conv_id < 60")
    assert compare(found.filter("conv_id < 60"), sql, ORACLE["op12_repair"]) is None


def test_repair_of_no_rows(spark):
    assert repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- phrases


def brute_phrases(docs, least=10, most=3, first=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, most + 1):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least}
        rows = []
        for p, a in often.items():
            if len(p) == 1:
                continue
            longer = (q for q in often if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if any(100 * often[q] >= 50 * a for q in longer):
                continue
            score, _, left, right = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def odd_texts():
    rng = random.Random(3)
    words = ["the", "The", "Étude", "x", "naïve", "日本", "new", "york", "city", "a-b", " z", "İ"] + [f"w{i}" for i in range(40)]
    docs = [(" ".join(rng.choices(words, k=rng.randint(0, 60))).replace("w3 ", "w3, ").replace("w4 ", "w4\n"), rng.choice(["en", "de", None, "e\tn"])) for _ in range(300)]
    docs += [(None, "en"), ("", None), ("  \t ", "fr"), ("new york city " * 30_000, "en"), ("q" * 70_000 + " r", "en"), ("New  york\tCity." * 20, "und")]
    return docs + docs[:40]


@pytest.mark.parametrize("keys, window", [(1_500_000, 4_000_000), (37, 500)])
def test_phrases_of_odd_texts(spark, monkeypatch, keys, window):
    monkeypatch.setattr(phrases, "TRIE_KEYS", keys)
    docs = odd_texts()
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "text string, lang string, number int, word string").repartition(3)
    found = phrases.collocations(df)
    rows = found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, rows)) == brute_phrases(docs)


def test_phrases_of_more_words_and_none(spark):
    docs = odd_texts()
    df = spark.createDataFrame(docs, "text string, lang string")
    found = phrases.collocations(df, least=4, most_words=4, first=50)
    assert sorted(map(tuple, found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == brute_phrases(docs, 4, 4, 50)
    assert phrases.collocations(df.limit(0)).count() == 0
    assert phrases.collocations(df.filter(F.length("text") < 3)).count() == 0


def test_words_in_windows_equal_whole_texts(monkeypatch):
    data = np.frombuffer("Ab cd.éf  g\nh i".encode(), np.uint8)
    starts, ends, cuts = phrases.read_window(data, 0, len(data), np.array([0, 4]))
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)] == ["Ab", "c", "d", "éf", "g", "h", "i"]
    assert cuts.tolist() == [5, 12]
