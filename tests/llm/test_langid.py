import dataclasses
import random
import re

import numpy as np
import pytest

from tidemark.llm import langid

WORDS = {"en": "the and of with this that from only thing water".split(), "de": "der die und nicht sich einer über schön werden".split(), "fr": "le la des une été vous très pour être avec".split()}


def text(rng, lang, n=30):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def corpus(n=240, seed=3):
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = ["en", "de", "fr"][i % 3]
        declared = lang if rng.random() < 0.9 else "en"
        rows.append((i, text(rng, lang), declared, f"http://w{i % 2}.{lang}site.{'com' if lang == 'en' else lang}/x", lang))
    return rows


SCHEMA = "doc_id long, text string, declared string, url string, truth string"


def brute_trigrams(t):
    raw = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 97 or 123 <= b <= 127 else b for b in t.encode())
    grams = [raw[i : i + 3] for i in range(len(raw) - 2)]
    return [(int.from_bytes(g, "little") * 2654435761 & 0xFFFFFFFF) >> 16 for g in grams if g[:2] != b"  "]


def test_trigrams_against_brute_force():
    import pyarrow as pa

    from tidemark.llm import bytewise

    texts = ["", "a", "Über ALL  12 x", "日本", "  ", "abc"]
    found, bounds = langid.trigrams(*bytewise.buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        assert found[bounds[i] : bounds[i + 1]].tolist() == brute_trigrams(t)


def test_languages_are_found_though_declarations_err(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    found = langid.identify(docs, declared_col="declared", url_col="url").collect()
    assert all(r.lang_id == r.truth and r.lang_accepted for r in found)


def test_hosts_and_suffixes_decide_where_the_text_is_silent(spark):
    rows = corpus() + [(900, "12 34", None, "http://new.desite.de/", "de"), (901, "", None, "http://other.fr/q", "fr"), (902, None, "de", None, "de")]
    found = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, SCHEMA), declared_col="declared", url_col="url").collect()}
    assert [found[i].lang_id for i in (900, 901, 902)] == ["de", "fr", "de"]
    assert not any(found[i].lang_accepted for i in (900, 901, 902))
    assert all(0 < r.lang_score <= 1 for r in found.values())


def test_nulls_repeats_clashing_columns_and_empty(spark):
    rows = [(None, None, None, None, None), (1, "the water", "en", None, None), (1, "the water", "en", None, None), (2, "x" * 300_000, None, "nonsense", None)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as lang_id", "2 as best", "3 as domain")
    found = langid.identify(docs, declared_col="declared", url_col="url")
    assert found.columns == [*docs.columns[:5], "best", "domain", "lang_id", "lang_score", "lang_accepted"]
    assert found.count() == 4
    assert langid.identify(docs.limit(0), declared_col="declared", url_col="url").count() == 0


def test_host_counts_do_not_outweigh_clear_text(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, "en"), "en", "http://a.com/", "en") for i in range(200)] + [(200 + i, text(rng, "de", 40), "de", "http://a.com/", "de") for i in range(20)]
    found = langid.identify(spark.createDataFrame(rows, SCHEMA), declared_col="declared", url_col="url").collect()
    assert np.mean([r.lang_id == r.truth for r in found]) == pytest.approx(1.0)


def test_languages_beyond_the_most_frequent_are_accepted_as_other(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    rows = [r for r in corpus() if r[4] != "fr"] + [r for r in corpus() if r[4] == "fr"][:40]
    found = langid.identify(spark.createDataFrame(rows, SCHEMA), declared_col="declared", url_col="url").collect()
    assert all(r.lang_accepted and r.lang_id == ("other" if r.truth == "fr" else r.truth) for r in found)


def brute_posteriors(rows, model):
    """The whole fusion by loops over documents: text, declaration, suffix, domain and host."""
    k, total = len(model.languages), {}

    def add(counts, key, best):
        counts.setdefault(key, np.zeros(k))
        if best >= 0:
            counts[key][best] += 1

    def smooth(n, parent, weight):
        return (n + weight * parent) / (n.sum() + weight)

    suffix = lambda h: h.rpartition(".")[2] if "." in h else ""
    domain = lambda h: ".".join(h.split(".")[-2:])
    made, suffixes, domains, hosts, declared = [], {}, {}, {}, {}
    for i, t, said, url, _ in rows:
        grams = brute_trigrams(t or "")
        ll = model.table[:, grams].astype(float).mean(axis=1) * min(len(grams) / langid.TEMPER, langid.MOST_EVIDENCE) if grams else None
        best = int(np.argmax(ll)) if grams else -1
        host = re.sub(r":\d*$", "", (url or "").partition("://")[2].partition("/")[0].lower())
        said = (said or "").partition("-")[0].lower()
        made.append((i, ll, host, said))
        for counts, key in ((total, ""), (suffixes, suffix(host)), (domains, domain(host)), (hosts, host), (declared, said)):
            add(counts, key, best)
    overall = (total[""] + 1) / (total[""] + 1).sum()
    found = {}
    for i, ll, host, said in made:
        by_suffix = smooth(suffixes[suffix(host)], overall, langid.HOST_WEIGHT)
        own = domain(host)
        # the suffix of a domain is that of its name
        prior = smooth(hosts[host], smooth(domains[own], by_suffix if suffix(own) == suffix(host) else overall, langid.HOST_WEIGHT), langid.HOST_WEIGHT)
        says = np.log(smooth(declared[said], overall, langid.TABLE_WEIGHT)) - np.log(overall) if said else 0.0
        score = np.log(prior) + says + (ll if ll is not None else 0.0)
        p = np.exp(score - score.max())
        p /= p.sum()
        found[i] = (model.languages[int(np.argmax(p))], float(p.max()), ll is not None and p.max() >= 0.5)
    return found


def test_posteriors_against_brute_force(spark):
    rng = random.Random(7)
    rows = corpus(150) + [(500 + i, text(rng, rng.choice(["en", "de", "fr"]), rng.choice([0, 1, 2])), rng.choice([None, "de-AT", "FR", "xx"]), rng.choice([None, "", "http://x.de/", "http://a.b.frsite.fr:80/q", "http://localhost/"]), "") for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = dataclasses.replace(langid.fit_text(docs.select("text", docs.declared.alias("language")).where("doc_id < 500")), fitted_below=0)
    found = {r.doc_id: r for r in langid.identify(docs, declared_col="declared", url_col="url", model=model).collect()}
    wanted = brute_posteriors(rows, model)
    for i, (language, score, accepted) in wanted.items():
        assert found[i].lang_score == pytest.approx(score, abs=1e-6)
        assert found[i].lang_accepted == accepted and (found[i].lang_id == language or score < 0.51)
