import math
import random
import re
import zlib
from collections import Counter, defaultdict

from lodestone.llm.langid import LETTERS, Scorer, fit, grams_of, identify, op8_language_id


def test_held_out_accuracy(spark, docs):
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = op8_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    out = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in out) >= 0.97 * len(out)


def test_backoff(spark):
    rows = [(i, "the cat sat on the mat", "en") for i in range(5)] + [(i + 9, "le chat est sur le tapis", "fr") for i in range(5)]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    score = Scorer(model)
    assert model.langs == ["en", "fr"]
    got = score(["the", "chat", "tapisserie", "matter", "123 ...", None, "", "le chat, the mat"])
    assert [g[0] for g in got[:4]] == ["en", "fr", "fr", "en"] and got[4:7] == [("und", 0.0, 0.0)] * 3
    assert got[7] == score(["le chat, the mat"])[0]


def test_odd_rows(docs, odd, empty):
    model = fit(docs)
    rows = identify(odd, model, keep=("doc_id", "lang")).collect()
    assert len(rows) == odd.count()
    assert sum(r["lang_pred"] == "und" for r in rows) == 3
    assert identify(empty, model).count() == 0
    none = fit(empty)
    assert none.langs == [] and {r["lang_pred"] for r in identify(odd, none).collect()} == {"und"}


def test_a_rare_language_is_learnt_whole(spark, monkeypatch):
    from lodestone.llm import langid

    monkeypatch.setattr(langid, "SAMPLE_DOCS", 200)
    rows = [(i, "the words of that common tongue " * 2, "en") for i in range(20000)] + [(10**6 + i, "zut voici quelques mots rares", "fr") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.langs == ["en", "fr"] and model.prior[0] - model.prior[1] > 8
    got = langid.identify(docs.where("lang = 'fr'"), model).collect()
    assert len(got) == 2 and {r["lang_pred"] for r in got} == {"fr"}


def brute(train, texts):
    """The back-off by dictionaries, word by word."""
    langs = sorted({lang for _, lang in train})
    tables = []
    for n in range(5):
        own = defaultdict(Counter)
        for text, lang in train:
            for word in LETTERS.findall(text.lower()):
                own[lang].update([word] if n == 0 else grams_of(word, n))
        keys = set().union(*own.values())
        total = {x: sum(own[x].values()) + 0.5 * len(keys) for x in langs}
        tables.append({k: [math.log((own[x][k] + 0.5) / total[x]) for x in langs] for k in keys})
    letters = [sum(len(w) for t, x in train if x == lang for w in LETTERS.findall(t.lower())) for lang in langs]
    prior = [math.log((n + 1) / (sum(letters) + len(langs))) for n in letters]
    relative = lambda row: [x - max(row) for x in row]
    out = []
    for text in texts:
        words = LETTERS.findall((text or "").lower())
        if not words:
            out.append(("und", 0.0))
            continue
        total = list(prior)
        for word in words:
            rows = [relative(tables[0][word])] if word in tables[0] else []
            for n in range(4, 0, -1):
                if not rows:
                    rows = [relative(tables[n][g]) for g in grams_of(word, n) if g in tables[n]]
            for i in range(len(langs)):
                total[i] += sum(r[i] for r in rows) / max(1, len(rows))
        logits = [x / math.sqrt(len(words)) for x in total]
        odds = [math.exp(x - max(logits)) for x in logits]
        out.append((langs[odds.index(max(odds))], max(odds) / sum(odds)))
    return out


def test_backoff_against_brute_force(spark, docs):
    rng = random.Random(2)
    train = [(r["text"], r["lang"]) for r in docs.limit(60).collect()] + [("Ψ ω únique", "xx")]
    texts = [r["text"] for r in docs.limit(90).collect()[60:]] + ["zzqx", "Ωψ", "½ ² ① Ⅷ 7", None, "únique ½cup"]
    texts += ["".join(rng.choices("abcdeéñ \n", k=40)) for _ in range(40)]
    rows = [(i, t, x) for i, (t, x) in enumerate(train)]
    got = Scorer(fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")))(texts)
    for (a, p, _), (b, q), text in zip(got, brute(train, texts), texts):
        assert abs(p - q) < 1e-3 and (a == b or p < 0.501), text  # two can tie


def test_letters_are_of_category_l():
    import unicodedata

    for c in map(chr, range(0x3000)):
        letter = unicodedata.category(c)[0] == "L"
        assert bool(LETTERS.fullmatch(c)) == letter, hex(ord(c))
    assert re.fullmatch(LETTERS, "naïve") and not LETTERS.search("½ ² ① Ⅷ 12_")
