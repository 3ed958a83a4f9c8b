"""Queries over their whole tables against definitions written out plainly, and odd rows by value."""

import hashlib
import re
from collections import Counter

import pytest

from gridloom.llm import bpe, importance, lm_score, mixing, quality_rules, queries, secrets, sketch, urls, wrapper
from gridloom.llm.queries import tokenizer_path

from test_llm import SF, docs, empty, filled, odd, rows, words  # noqa: F401

BASE = (
    ("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6, 1),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 20, 0),
    ("hex", re.compile(r"[0-9a-f]+"), 24, 0),
)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def base_spans(text):
    found = []
    for order, (kind, pattern, least, group) in enumerate(BASE):
        found += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text) if len(m[group]) >= least]
    return [s for _, _, s in sorted(found)]


def test_secrets_of_all_documents(spark):
    folder = "/root/testdata/sf0.01"  # the smaller one has none
    texts = spark.read.parquet(f"{folder}/documents.parquet").collect()
    found = {r.doc_id: r for r in queries.op8_secret_scan(spark, folder).collect()}
    assert len(found) == len(texts)
    some = 0
    for r in texts:
        want, f = base_spans(r.text or ""), found[r.doc_id]
        some += len(want)
        counts = Counter(s.split(":")[0] for s in want)
        assert (f.n_assign, f.n_access, f.n_hex) == (counts["assign"], counts["access"], counts["hex"])
        assert f.base_sha256 == sha(",".join(want))
        assert set(want) <= set(f.spans.split(","))
    assert some > 0


def test_urls_of_all_pages(spark):
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = queries.op9_url_filter(spark, SF).collect()
    assert len(found) == len(pages)
    for r in found:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", pages[r.page_id] or "")
        host, path = (re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [k for k in rules if ("." + host).endswith("." + k[: k.index("/")]) and path.startswith(k[k.index("/") :])]
        rule = max(fits, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == rules[rule] if rule else r.verdict in ("allow", "block")


def test_mix_of_all_documents(spark, rows):  # noqa: F811
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    of = Counter()
    for r in rows:
        of[r.source] += size[r.doc_id]
    targets, source = filled(of), {r.doc_id: r.source for r in rows}
    found = queries.op10_mix_sources(spark, SF).collect()
    assert sorted(r.doc_id for r in found) == sorted(size)
    for r in found:
        assert (r.size, r.source_size) == (size[r.doc_id], of[source[r.doc_id]])
        assert r.target == pytest.approx(targets[source[r.doc_id]])
        assert 0 <= r.taken <= 2 * r.size and (r.taken % r.size == 0 if r.size else r.taken == 0)


def test_fingerprints_of_all_documents(spark, rows):  # noqa: F811
    found = {r.doc_id: r for r in queries.op5_document_fingerprints(spark, SF).collect()}
    order = sorted(rows, key=lambda r: -r.doc_id)
    same = {}
    for r, after in zip(order, [*order[1:], order[0]]):
        f, g = found[r.doc_id], found[after.doc_id]
        assert f.near_next == sketch.likeness(sketch.from_text(f.fingerprint), sketch.from_text(g.fingerprint))
        assert f.near_edited == sketch.likeness(sketch.from_text(f.fingerprint), sketch.from_text(f.edited_fingerprint))
        assert f.fingerprint == sketch.to_text(sketch.sketched([r.text])[0])
        assert same.setdefault(r.text or "", f.fingerprint) == f.fingerprint


def test_pages_do_not_hang_on_what_runs_beside_them(spark):
    """Every page once; text without markup, trimmed, single blanks; the same from other partitions."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r.page_id: r for r in queries.op6_html_extraction(spark, SF).collect()}
    assert len(found) == pages.count()
    for r in found.values():
        assert r.n_chars == len(r.text) and r.text == " ".join(r.text.split(" ")).strip() and "<script" not in r.text
    again = {r.page_id: r.text for r in wrapper.extract_main_text(pages.repartition(5)).collect()}
    assert again == {k: r.text for k, r in found.items()}


# --- odd rows, by value ---------------------------------------------------------------------------


def test_rules_of_odd_rows(odd, empty):  # noqa: F811
    found = Counter((r.doc_id, r.n_words, r.n_repeat_words, r.base_failed, r.kept) for r in quality_rules.quality_rules(odd).collect())
    assert found == Counter({(1, 0, 0, True, False): 1, (None, 3, 0, True, False): 1, (2, 0, 0, True, False): 2, (3, 24000, 24000, True, False): 1, (4, 4, 0, True, False): 1})
    assert quality_rules.passed(odd).count() == 0 and quality_rules.passed(odd).columns == odd.columns
    assert quality_rules.quality_rules(empty).count() == 0


def test_scores_of_odd_rows(odd):  # noqa: F811
    found = lm_score.lm_scores(odd).collect()
    assert Counter((r.doc_id, r.n_words) for r in found) == Counter({(1, 0): 1, (None, 3): 1, (2, 0): 2, (3, 24000): 1, (4, 4): 1})
    for r in found:
        assert (r.score == 0 and r.mean_score is None) if r.n_words == 0 else r.score < 0


def test_fingerprints_of_odd_rows(odd):  # noqa: F811
    found = sketch.edit_fingerprints(odd).collect()
    texts = Counter((r.doc_id, len(r.text or "")) for r in odd.collect())
    assert Counter((r.doc_id, r.n_chars) for r in found) == texts
    bare = {r.fingerprint for r in found if r.n_chars == 0}
    assert len(bare) == 1 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert bare.isdisjoint(r.fingerprint for r in found if r.n_chars)


def test_bpe_of_odd_rows(odd):  # noqa: F811
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in odd.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))] += 1
    found = bpe.encoded(odd, tokenizer_path()).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == want


def test_secrets_of_odd_rows_by_value(odd):  # noqa: F811
    want = Counter((r.doc_id, sha(",".join(base_spans(r.text or "")))) for r in odd.collect())
    assert Counter((r.doc_id, r.base_sha256) for r in secrets.secret_scan(odd).collect()) == want


def test_resampling_of_odd_rows(spark, odd, empty):  # noqa: F811
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1)], "doc_id long, quality int")
    found = importance.importance_resample(odd, labels).collect()
    assert Counter(r.doc_id for r in found) == Counter({1: 1, None: 1, 2: 2, 3: 1, 4: 1})
    assert importance.importance_resample(empty, labels).count() == 0
    assert importance.importance_resample(odd, labels.limit(0)).count() == 6


def test_urls_of_odd_rows(spark):
    schema = "page_id long, url string, host string, rule string, html string"
    long_ = "http://a.com/" + "x" * 100_000
    table = [(1, None, "h", "r", None), (None, "", "h", "r", ""), (2, "://", "h", "r", ""), (3, long_, "h", "r", ""), (3, long_, "h", "r", ""), (4, "http://COM/en/", None, None, None)]
    found = urls.url_filter(spark.createDataFrame(table, schema)).collect()
    got = Counter((r.page_id, r.host, r.path, r.rule) for r in found)
    assert got == Counter({(1, "", "", None): 1, (None, "", "", None): 1, (2, "", "", None): 1, (3, "a.com", long_[12:], None): 2, (4, "com", "/en/", "com/en/"): 1})
    assert len({r.verdict for r in found if r.page_id == 3}) == 1
    assert urls.url_filter(spark.createDataFrame([], schema)).count() == 0


def test_pages_of_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars long, slots string, host string"
    body = "<html><body><article><p>One &amp; two</p><p>three\n four</p></article></body></html>"
    table = [(1, None, body), (1, None, body), (None, "http://a.org/1", None), (2, "http://a.org/2", ""), (3, "", "plain words"), (4, "http://b.org/x", "<p>" + "long " * 50_000 + "</p>")]
    found = wrapper.extract_main_text(spark.createDataFrame([(*r, "t", 5, "s", "h") for r in table], schema)).collect()
    got = Counter((r.page_id, r.text, r.n_chars) for r in found)
    long_ = ("long " * 50_000).strip()
    assert got == Counter({(1, "One & two three four", 20): 2, (None, "", 0): 1, (2, "", 0): 1, (3, "plain words", 11): 1, (4, long_, len(long_)): 1})
    assert wrapper.extract_main_text(spark.createDataFrame([], schema)).count() == 0


def test_mix_of_odd_rows_by_value(odd):  # noqa: F811
    found = mixing.mix_sources(odd).collect()
    sizes = Counter()
    for r in odd.collect():
        sizes[r.source] += len(words(r.text))
    targets = filled(sizes)
    source = {1: None, None: "s", 2: "t", 3: "t", 4: "t"}
    for r in found:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(targets[source[r.doc_id]])
        assert 0 <= r.taken <= 2 * r.size
    assert Counter((r.doc_id, r.size) for r in found) == Counter({(1, 0): 1, (None, 3): 1, (2, 0): 2, (3, 24000): 1, (4, 4): 1})
