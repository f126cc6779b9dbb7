import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellar.llm.leakage import build_index, find_in, leaks
from tessellar.llm.mojibake import garbled, repair
from tessellar.llm.packing import CAPACITY, VOCABULARY, best_fit, count_tokens, pack, summary

CLEAN = [
    "Déjà vu: «Größere» Umbauten — naïve façade, 5 € für £3 ± 2 µs…", "Ветка отстаёт от основной на 7 изменений. Сначала выполните git fetch.", "作業を退避してから切り替えます。", "├── src\n│   └── café.txt\n→ done", "plain ascii", "NÃO É “fácil”… “olé”…",
    "Г»лава «Г», «В» и «ВНИМАНИЕ»", "AT&T &copy; &amp; R&D", "L’été, à « Noël »… “café”…", "ESPAÑA… ¿Qué? ¡Sí!",
]


@pytest.mark.parametrize("t", CLEAN)
def test_clean_texts_stay(t):
    assert repair(t) == (t, 0, False)


@pytest.mark.parametrize("t", [CLEAN[0], CLEAN[1], CLEAN[2], CLEAN[3]])
@pytest.mark.parametrize("page", ["latin-1", "cp437", "cp850", "mac_roman", "twice", "cp1251", "cp1252"])
def test_utf8_read_with_another_page(t, page):
    try:
        bad = t.encode().decode("latin-1").encode().decode("latin-1") if page == "twice" else t.encode().decode(page)
    except UnicodeDecodeError:
        bad = "".join(bytes([b]).decode(page, "ignore") or chr(b) for b in t.encode())
    fixed, n, lost = repair(bad)
    assert n and not lost
    if page in ("latin-1", "twice", "cp1252"):
        assert fixed == t


@pytest.mark.parametrize("wrong,right", [("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp1251", "cp866"), ("cp1252", "cp1251")])
def test_cyrillic_pages(wrong, right):
    t = "Ветка отстает от основной на много изменений и после слияния появились конфликты"
    bad = "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in t.encode(right))
    fixed, n, _ = repair("See branch: " + bad + " (docs)")
    assert n and fixed == "See branch: " + t + " (docs)"


def test_japanese_page_entities_and_losses():
    t = "衝突が起きたらファイルを開いて手で直します。"
    bad = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in t.encode("cp932"))
    assert repair(bad)[0] == t
    assert repair("The fa&Atilde;&sect;ade &amp; R&D")[0] == "The façade &amp; R&D"
    assert repair("caf�") == ("caf�", 0, True)
    assert repair(None) == (None, 0, False) and repair("") == ("", 0, False)


def test_garbled_rows(spark):
    rows = [(1, "fine"), (2, "CafÃ© here"), (2, "CafÃ© here"), (3, None), (4, ""), (5, "x�"), (6, "naïve " * 5000 + "Ã©")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"restored": F.lit(1), "_id": F.lit(2)})
    got = sorted((r["doc_id"], r["spans"], r["lost"]) for r in garbled(df, "doc_id", "text").collect())
    assert got == [(2, 1, False), (2, 1, False), (5, 0, True), (6, 1, False)]
    assert garbled(df.limit(0), "doc_id", "text").count() == 0


def _norm(t):
    w = t.lower().split()
    return f" {' '.join(w)} " if w else ""


def test_passages_match_brute_force():
    rng = random.Random(3)
    vocab = ["a", "commit", "branch", "the", "of", "x1", "merge", "git", "undone", "stash"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(3, 40)))) for k in range(25)]
    docs = []
    for _ in range(80):
        d = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.7:
            w = rng.choice(items)[1].split()
            s = rng.randrange(len(w))
            d[len(d) // 2 : len(d) // 2] = w[s : s + rng.randrange(1, 20)]
        docs.append(" ".join(d))
    grams = lambda t: {tuple(t.split()[i : i + 6]) for i in range(len(t.split()) - 5)}
    want = {(r, k) for r, d in enumerate(docs) for k, t in items if grams(d) & grams(t)}
    x = build_index([(k, _norm(t)) for k, t in items], 6, 0, 8)
    got = {(r, int(x.ids[i])) for r, i, _ in find_in([_norm(d) for d in docs], x)}
    assert got == want


def test_passages_with_edits(spark):
    item = "recover the lost file at revision seven then place everything under the old folder unchanged and report the branch name"
    doc = "noise words first " + item.replace("revision", "revison").replace("folder", "foldder") + " and more noise behind"
    cut = " ".join(item.split()[:8])
    docs = spark.createDataFrame([(1, doc), (2, cut), (3, None), (4, ""), (5, "unrelated " * 400), (6, "pad " * 3000 + item)], "doc_id bigint, text string").withColumn("_t", F.lit("clash"))
    items = spark.createDataFrame([(10, item), (11, "too short"), (12, None)], "item_id bigint, text string")
    find = lambda **k: {(r["doc_id"], r["item_id"]) for r in leaks(docs, "doc_id", "text", items, "item_id", "text", words=10, **k).collect()}
    assert find(edits=3) == {(1, 10), (6, 10)} and find() == {(6, 10)}
    assert leaks(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0 and leaks(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_long_documents_are_read_to_the_end(spark, monkeypatch):
    from tessellar.llm import leakage

    monkeypatch.setattr(leakage, "CHUNK", 500)
    item = _norm("one two three four five six seven eight nine ten eleven twelve thirteen")
    x = build_index([(1, item)], 12, 0, 16)
    for pad in range(380, 520, 7):
        assert find_in([_norm("z " * (pad // 2)) [:-1] + item + "q " * 300], x), pad


def test_best_fit_keeps_every_constraint():
    rng = np.random.default_rng(1)
    t = np.sort(rng.integers(1, 100, 400))[::-1]
    for docs, cost in ((1000, 10_000), (3, 10_000), (1000, 6_000), (2, 4_000)):
        b = best_fit(t, 100, docs, cost)
        many = np.bincount(b) > 1
        assert np.bincount(b, weights=t).max() <= 100 and np.bincount(b).max() <= docs and np.bincount(b, weights=t * t)[many].max() <= cost
    assert len(set(best_fit(t, 100, 1000, 4_000))) > len(set(best_fit(t, 100, 1000, 10_000))) < len(set(best_fit(t, 100, 2, 10_000)))
    assert len(set(best_fit(t, 100, 1000, 10_000))) <= 1.05 * t.sum() / 100


def test_packing(spark):
    import os

    if not os.path.exists(VOCABULARY):
        pytest.skip("no vocabulary")
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["undo", "the", "last", "commit"]) for _ in range(rng.choice([1, 5, 40, 300])))) for k in range(150)]
    rows += [(500, "word " * 1000), (501, None), (502, ""), (503, "a" * 3000), (0, "again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"n": F.lit(1), "row": F.lit(2), "container": F.lit("x")})
    got = pack(df, "doc_id", "text", capacity=256, shard_tokens=3000).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["token_start"], r["token_end"]))
    want = {}
    for i, t in rows:
        if t:
            want[i] = want.get(i, 0) + count_tokens(t)
    assert {i: sum(b - a for a, b in v) for i, v in by.items()} == want
    assert all(len(v) == 1 for i, v in by.items() if i and want[i] <= 256) and len(by[500]) == -(-want[500] // 256)
    s = summary(pack(df, "doc_id", "text", capacity=256, shard_tokens=3000), 256).collect()
    assert max(r["tokens"] for r in s) <= 256 and len(s) <= -(-sum(want.values()) // 256) + 4
    assert pack(df.limit(0), "doc_id", "text").count() == 0
    assert CAPACITY == 2048


SCRIPTS = {
    "greek": "Η ομάδα συγχωνεύει τις αλλαγές", "korean": "변경 사항을 병합하세요", "hebrew": "מיזוג שינויים בענף", "arabic": "دمج التغييرات في الفرع", "thai": "รวมการเปลี่ยนแปลง", "vietnamese": "Hợp nhất các thay đổi của nhánh",
    "hindi": "शाखा में बदलाव मिलाएं", "polish": "Połącz zmiany w gałęzi źródłowej", "czech": "Sloučit změny ve větvi přes účet", "chinese": "合并分支中的更改", "ukrainian": "Злиття змін у гілці їжак", "turkish": "Değişiklikleri birleştir ığüşöç",
}


def misread(t, page, written="utf-8"):
    return "".join(bytes([b]).decode(page, "ignore") or chr(b) for b in t.encode(written))


@pytest.mark.parametrize("t", SCRIPTS.values(), ids=SCRIPTS)
def test_scripts(t):
    assert repair(t) == (t, 0, False)
    for page in ("cp1252", "latin-1", "mac_roman", "cp437", "koi8_r"):
        fixed, n, lost = repair("Note: " + misread(t, page) + " (docs)")
        assert n and not lost and fixed == "Note: " + t + " (docs)", page


@pytest.mark.parametrize("name,written", [("chinese", "gbk"), ("chinese", "gb18030"), ("greek", "cp1253"), ("polish", "cp1250"), ("hebrew", "cp1255"), ("arabic", "cp1256"), ("korean", "euc_kr"), ("turkish", "cp1254"), ("thai", "cp874")])
def test_no_wrong_text_is_returned(name, written):
    t = "Note: " + misread(SCRIPTS[name], "cp1252", written) + " (docs)"
    assert repair(t)[0] == t
