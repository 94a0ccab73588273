"""The registered secret scan keeps a ledger: no pair of blob and rule version is scanned twice."""

from collections import Counter

from cases import no_documents
from test_corpus import secret_documents

from llm import secrets


def test_the_query_scans_each_pair_once(spark):
    docs = secret_documents(spark)
    report, findings, ledger = secrets.ledgered_report(docs)
    pairs = Counter(map(tuple, ledger.collect()))
    blobs = docs.select(secrets.blob_of(docs.text).alias("b")).distinct().count()
    assert set(pairs.values()) == {1} and len(pairs) == blobs * len(secrets.RULES)
    assert Counter(map(tuple, findings.collect())) == Counter(map(tuple, secrets.scan(docs).collect()))
    assert Counter(map(str, report.collect())) == Counter(map(str, secrets.secret_report(docs).collect()))


def test_a_new_rule_version_is_scanned_alone(spark):
    docs = secret_documents(spark)
    changed = tuple(secrets.Rule(r.kind, 2, r.pattern, r.group, r.least) if r.kind == "hex" else r for r in secrets.RULES)
    _, findings, ledger = secrets.ledgered_report(docs, steps=(*secrets.STEPS, changed))
    blobs = docs.select(secrets.blob_of(docs.text).alias("b")).distinct().count()
    assert ledger.count() == ledger.distinct().count() == blobs * (len(secrets.RULES) + 1)
    assert {r.rule for r in findings.select("rule").distinct().collect()} == {r.name for r in (*secrets.RULES, *changed)}


def test_empty_table(spark):
    report, findings, ledger = secrets.ledgered_report(no_documents(spark))
    assert report.count() == findings.count() == ledger.count() == 0
