"""Each operator against brute force, on the small tables and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from signalcheck.llm import decontaminate, extract, licenses, packing, pii, quality, rules, simhash, token_counts, toxicity

SCHEMA = "doc_id long, text string, score double, fp long"
ROWS = [
    (1, "a b c d e f g h i j k", 0.1, 1), (2, None, None, None), (None, "mail me@x.example.com now", 0.2, 2), (3, "", 0.3, 3),
    (4, "a b c d e f g h i j k", 0.1, 1), (4, "a b c d e f g h i j k", 0.1, 1), (5, "long word " * 30_000, 0.5, 5),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize("query, label", [(toxicity.op1_toxicity, "toxic"), (quality.op2_quality, "quality")])
def test_held_out_accuracy(spark, query, label):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = query(spark, folder).join(labels, "doc_id").filter("held_out").select("score", label).toPandas()
    assert auc(found["score"].to_numpy(), found[label].to_numpy()) > 0.9


def test_classifiers_take_odd_rows_and_no_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for fit, score in ((toxicity.fit_toxicity, toxicity.score_toxicity), (quality.fit_quality, quality.score_quality)):
        weights = fit(odd, none)
        assert score(odd, weights).filter("score between 0 and 1").count() == len(ROWS)
        assert score(odd.limit(0), weights).count() == 0


def brute_windows(benchmark):
    out = {}
    for item, text in benchmark:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        for i in range(max(1, len(words) - 9) if words else 0):
            out.setdefault(tuple(words[i : i + 10]), set()).add(str(item))
    return out


def test_decontamination_is_brute_force(spark, folder, texts):
    windows = brute_windows(spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect())
    hits = 0
    for row in decontaminate.op3_decontaminate(spark, folder).collect():
        text = re.sub("[A-Z]", lambda m: m[0].lower(), texts[row.doc_id])
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        hit, items = set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                own = windows.get(tuple(words[i : i + size]))
                if own:
                    items |= own
                    hit.update(range(i, i + size))
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        assert (row.n_words, row.n_hit, row.n_items, row.items_sha256) == (len(words), len(hit), len(items), digest)
        hits += bool(hit)
    assert hits


def test_shards_without_the_later_words_of_the_benchmark():
    windows = decontaminate.Windows([(1, "a b c"), (2, " ".join(f"w{i}" for i in range(5_000)))])
    assert decontaminate.find([[b"x", b"a", b"b", b"c"], []], windows)[0] == [(1, 4, windows.windows.index((1, 2, 3)))]


def test_passages_are_cut_and_odd_rows_stay(spark, odd):
    windows = decontaminate.Windows([(1, "a b c d e f g h i j"), (2, None), (3, "me")])
    left = decontaminate.remove_passages(odd, windows)
    assert left.columns == odd.columns
    found = Counter(r.text for r in left.collect())
    assert found[" k"] == 3 and found["mail @x.example.com now"] == 1 and found[""] + found[None] == 2
    assert decontaminate.search_documents(odd.limit(0), windows).count() == 0


def test_token_counts_are_the_library(spark, folder, texts):
    library = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    for row in token_counts.op4_token_counts(spark, folder).collect():
        assert row.n_tokens == len(library.encode(texts[row.doc_id], add_special_tokens=False).ids)
        assert row.n_bytes == len(texts[row.doc_id].encode())


@pytest.mark.parametrize("text", ["a<|endoftext|>b  <|endoftext|>", "it's 12² \x1cx　y\n\n z", "\U0001f600é ΣΣ", None])
def test_tokens_of_special_texts(spark, text):
    row = spark.createDataFrame([(1, text)], "doc_id long, text string")
    library = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    found = token_counts.count_tokens(row, public_tokenizers.path(token_counts.VOCABULARY)).first()
    assert found.n_tokens == len(library.encode(text or "", add_special_tokens=False).ids)
    words = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    pieces = packing.to_pieces(row, public_tokenizers.path(packing.VOCABULARY)).collect()
    assert sum(p.length for p in pieces) == len(words.encode(text or "", add_special_tokens=False).ids) + 1


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        total = sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return 8 <= len(digits) <= 15 if kind == "phone" else True


def base(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if good(k, m[0])]


def test_personal_data_is_brute_force(spark, odd):
    extra = [
        (10, "a@b.c_x@d.e f@g 1.2.3.4.5.6.7.8 001.2.3.256 \U0001f600 9.9.9.9", None, None), (11, "x" * 50_000 + " 1-" * 9_000, None, None),
        (12, "4111 1111-1111 1111 4111111111111112 +1 (555) 010-9999 +12", None, None), (13, "1 " * 20_000 + "a.b." * 9_000, None, None),
    ]
    docs = odd.unionByName(spark.createDataFrame(extra, SCHEMA))
    found = pii.find_personal(docs).collect()
    assert len(found) == len(ROWS) + len(extra)
    by_id = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base] for r in found}
    for doc_id, text, *_ in ROWS + extra:
        assert by_id[doc_id] == base(text)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[None] == "mail [EMAIL] now" and clean[1] == ROWS[0][1]


def test_terms_that_disclose_an_entity(spark):
    rows = [(i, f"call Zorblatt at z@x.example.com, {w}") for i, w in enumerate(("alpha", "betaa", "gamma", "delta"))]
    rows += [(100 + i, f"call someone else about {i}") for i in range(200)]
    found = pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    words = {rows[r.doc_id][1][s.start : s.end] for r in found if r.doc_id < 4 for s in r["all"] if s.kind == "term"}
    assert words == {"Zorblatt"}


def test_rules_are_brute_force(spark, folder, texts):
    for row in rules.op6_rules(spark, folder).collect():
        text = texts[row.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        hit = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
        assert row.base_failed == (len(words) < 20 or 100 * len(hit) > 30 * len(words))
        assert not (row.base_failed and row.kept)


def test_rules_take_odd_rows(spark, odd):
    path = public_tokenizers.path(rules.VOCABULARY)
    assert rules.apply_rules(odd, path).count() == len(ROWS)
    assert rules.apply_rules(odd.limit(0), path).count() == 0


CLEAN = {
    "thai": "ประเทศไทยมีอาหารอร่อย และ ผู้คน ใจดี มาก วันนี้ อากาศ ร้อน เด็ก ๆ เล่น น้ำ ที่ สวน ใกล้ บ้าน ของ ยาย แล้ว กลับ มา กิน ข้าว เย็น ด้วยกัน",
    "bengali": "আজ সকালে আমরা নদীর ধারে হাঁটতে গিয়েছিলাম এবং অনেক পাখি দেখেছি তারপর বাজার থেকে মাছ ও সবজি কিনে বাড়ি ফিরে রান্না করেছি সবাই খুশি ছিল",
    "tamil": "இன்று காலை நாங்கள் கடற்கரைக்கு சென்றோம் அங்கே பல மக்கள் இருந்தனர் பின்னர் வீட்டிற்கு வந்து உணவு சமைத்து சாப்பிட்டோம் மாலை மழை பெய்தது நாங்கள் கதை படித்து தூங்கினோம் எல்லோரும் மகிழ்ச்சி நன்றி வணக்கம் மீண்டும் நாளை",
    "georgian": "დღეს დილით ჩვენ მდინარის პირას ვისეირნეთ და ბევრი ჩიტი ვნახეთ შემდეგ ბაზარში თევზი და ბოსტნეული ვიყიდეთ სახლში დავბრუნდით და ერთად ვივახშმეთ ყველა ბედნიერი იყო",
    "armenian": "Այսօր առավոտյան մենք քայլեցինք գետի ափով և տեսանք շատ թռչուններ հետո շուկայից ձուկ ու բանջարեղեն գնեցինք վերադարձանք տուն և միասին ընթրեցինք բոլորը ուրախ էին շատ",
    "ethiopic": "ዛሬ ጠዋት ወደ ወንዝ ሄድን ብዙ ወፎች አየን ከዚያ ገበያ ሄደን ዓሣ እና አትክልት ገዛን ወደ ቤት ተመለስን እና አብረን እራት በላን ሁሉም ደስተኛ ነበሩ ነገ እንደገና እንሄዳለን",
    "cyrillic": "Сегодня утром мы гуляли по берегу реки и видели много птиц потом купили рыбу и овощи на рынке вернулись домой и вместе поужинали все были очень рады",
}


def test_bands_keep_every_script_and_reject_garbled_words(spark, folder):
    random = np.random.default_rng(3)
    consonants = list("bcdfghjklmnpqrstvwxz")
    garbled = [" ".join("".join(random.choice(consonants, random.integers(3, 10))) for _ in range(80)) for _ in range(20)]
    rows = [(1_000_000 + i, "en", t) for i, t in enumerate(garbled)]
    rows += [(2_000_000 + i, None, t + " " + " ".join(t.split()[:k])) for i, t in enumerate(CLEAN.values()) for k in range(5)]
    extra = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("_group", F.lit("x"))
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text").withColumn("_group", F.lit("y"))
    both = docs.unionByName(extra)
    result = rules.apply_rules(both, public_tokenizers.path(rules.VOCABULARY))
    assert set(both.columns) <= set(result.columns)
    found = result.collect()
    assert not any(r.kept for r in found if 1_000_000 <= r.doc_id < 2_000_000)
    for i, name in enumerate(CLEAN):
        own = [r for r in found if r.doc_id == 2_000_000 + i]
        assert len(own) == 5 and all(r.script == name and r.kept == (not r.base_failed) for r in own)
        assert any(r.kept for r in own)
    plain = [r for r in found if r.doc_id < 1_000_000 and not r.base_failed]
    assert sum(r.kept for r in plain) >= 0.99 * len(plain)


def test_bands_are_quartiles_of_the_whole_group(spark):
    values = [(f"g{i % 2}", x / 1000, 0.0, 0.5, False) for i, x in enumerate(range(1_000, 1_400))] + [("g0", 9.0, 0.0, 0.5, True)]
    schema = "g string, chars_per_token double, byte_share double, entropy double, base_failed boolean"
    for parts in (1, 7):
        bands = rules.fertility_bands(spark.createDataFrame(values, schema).repartition(parts), "g").orderBy("g").collect()
        for g, row in enumerate(bands):
            own = sorted(v[1] for v in values if v[0] == f"g{g}" and not v[4])
            low, high = own[49], own[149]
            wide = rules.REACH * (1 + rules.DOUBT / 200) * (high - low)
            assert row.texts == 200
            assert row.g_band.chars_per_token_low == pytest.approx(low * 0.88 - wide)
            assert row.g_band.chars_per_token_high == pytest.approx(high * 1.12 + wide)


def test_quality_scores_are_calibrated_sparse_products(spark):
    """Held-out rows of the lesser class are found at the contract's cut, and scores are the plain product."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    weights = quality.fit_quality(docs, labels)
    rows = quality.score_quality(docs, weights, ["doc_id", "text"]).join(labels, "doc_id").filter("pmod(crc32(string(doc_id)), 5) = 0").collect()
    low, good = [r for r in rows if r.quality == 0], [r for r in rows if r.quality == 1]
    assert sum(r.score < 0.3 for r in low) >= 0.8 * len(low) and sum(r.score >= 0.3 for r in good) >= 0.98 * len(good)
    for r in rows[:50]:
        words = re.findall(r"\w+|[^\w\s]+", r.text or "")
        codes = [zlib.crc32(w.encode()) * 0x9E3779B97F4A7C15 for w in words]
        pairs = [a + zlib.crc32(w.encode()) * 0xC2B2AE3D27D4EB4F for a, w in zip(codes, words[1:], strict=False)]
        slots = {(c % 2**64) >> (64 - quality.BITS) for c in codes + pairs}
        margin = sum(weights[s] for s in slots) / max(len(slots), 1) ** 0.5 + weights[-1]
        assert r.score == pytest.approx(1 / (1 + np.exp(-margin)))


def brute_components(prints):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ordered = sorted(prints)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                parent[root(a)] = root(b)
    return {p: root(p) for p in prints}


def test_stars_and_components_are_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(-(2**63), 2**63, 40)
    prints = set(centres.tolist())
    for c in centres.tolist():
        for _ in range(12):
            c ^= 1 << int(rng.integers(0, 62))
            prints.add(c)
    want = brute_components(prints)
    classes = lambda m: {frozenset(p for p in m if m[p] == r) for r in set(m.values())}
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = {p: p for p in prints} | {r.node: r.root for r in simhash.components(simhash.links(nodes)).collect()}
    assert classes(found) == classes(want)
    split = simhash.links(nodes, group=1)  # every shared key is split by narrower masks
    found = {p: p for p in prints} | {r.node: r.root for r in simhash.components(split).collect()}
    assert classes(found) == classes(want)


def test_narrower_masks_bound_a_key():
    for mask in simhash.block_masks():
        for inner in simhash.narrower(mask):
            for last in simhash.narrower(inner):
                assert 64 - (last % 2**64).bit_count() <= 19 and last & mask == mask


def test_one_row_of_each_group_stays(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (None, "x y z w"), (2, None), (3, ""), (5, "k l m n"), (5, "k l m n"), (6, "K l m n")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, "a b c d"), (0, "x y z w"), (2, ""), (5, "k l m n")]


def test_fingerprints_and_odd_rows(spark, odd):
    import xxhash

    words = "One two THREE four five".lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), seed=42) for i in range(3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 3)
    assert simhash.fingerprint("One two  THREE\nfour five") & (2**64 - 1) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" ") == 0
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == len(ROWS)
    assert {r.component_id for r in found if r.doc_id in (1, 4)} == {1}
    assert {r.component_id for r in found if r.doc_id in (2, 3)} == {2}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_page_text(spark, folder):
    model = extract.fit_extractor(spark.read.parquet(f"{folder}/pages.parquet"))
    page = (
        "<html><head><title>T</title><script>'</p>'</script></head><body><nav><a>m</a></nav><div class='ad'>buy</div>"
        "<article><h1>A &amp; B</h1><p>one  <b>two</b>\n three<p>four<!-- no --><div class=comments><p>me too</p></div></article>"
        "<footer>f</footer>"
    )
    assert extract.main_text(page, model) == "A & B\none two three\nfour"
    assert extract.main_text(None, model) == extract.main_text("<nav>x</nav>", model) == ""
    for row in extract.op8_extract(spark, folder).collect():
        assert row.n_chars == len(row.text) > 0


def test_packing_is_a_round_trip(spark, folder, texts):
    pieces = packing.op9_packing(spark, folder).collect()
    bins, docs = {}, {}
    for p in pieces:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
        docs.setdefault(p.doc_id, []).append((p.piece, p.start, p.length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert docs.keys() == texts.keys()
    total = sum(p.length for p in pieces)
    assert len(bins) <= total / packing.CAPACITY + 2 + 0.01 * len(bins)


def test_ids_of_plain_and_other_texts_are_the_library():
    path = public_tokenizers.path(packing.VOCABULARY)
    library, ids_of = Tokenizer.from_file(path), packing.encoder(path)
    odd = ["don't 'since ''s", "a<|endoftext|>b <|", "x'LL9_9 I'VE''RE 12''", "ÀÉ½² Straße ΣΑΣ", "ǅ İstanbul Ⱥ", "e\u0301 é", "中文 字", ""]
    for text in odd + [f"{chr(c)}A{chr(c)} b" for c in (*range(0x20, 0x530), *range(0x2000, 0x2070))]:
        assert ids_of(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_local_search_empties_bins():
    lengths = [6, 6, 4, 4, 3, 3, 2, 2]
    packed = packing.improve([[0, 4], [1, 5], [2, 3], [6], [7]], lengths, 10)
    assert len(packed) == 4 and sorted(i for b in packed for i in b) == list(range(8))


def test_licence_labels(spark, odd):
    rows = [
        (1, "Licensed under CC BY-NC 4.0. All rights reserved."), (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, "Released under the very MIT License, it is said."), (4, "the rights of all"), (5, None), (6, "cc"), (None, "CC-BY cc by"),
    ]
    found = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) == len(rows)
    assert (found[1].base_labels, found[1].labels) == ("cc-by,reserved", "cc-by,cc-by-nc,reserved")
    assert (found[1].n_base, found[1].first_word, found[1].last_word) == (2, 2, 7)
    assert found[2].base_labels == "gpl" and found[4].labels == "" and found[5].n_words == 0 and found[None].n_base == 2
    assert licenses.scan_licenses(odd).count() == len(ROWS)
    assert licenses.scan_licenses(odd.limit(0)).count() == 0


def test_pipeline(spark, folder, texts):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    packed = corpus_pipeline.run(spark, folder)
    assert 0 < packed.select("doc_id").distinct().count() <= len(texts)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert labels.count() > 0 and F is not None
