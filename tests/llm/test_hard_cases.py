"""Rows that share an id, odd column names, odd lengths, forms to fill in: nothing is lost and every job ends."""

import random
import string
from collections import Counter

import pytest

from tablewise.llm import ngram_join, pii, quality, suffix_dedup


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(n))


def covered(texts, length):
    """Bytes removed of each text, by a count of all strings of that length."""
    counts = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = set()
        for i in range(len(t) - length + 1):
            if counts[t[i:i + length]] > 1:
                gone |= set(range(i, i + length))
        out.append(len(gone))
    return out


@pytest.mark.parametrize("length", [2, 40, 59, 250, 1200, 5000])
def test_repeats_of_any_length_and_texts_that_share_an_id(spark, length):
    rng = random.Random(length)
    shared = prose(rng, 1500 if length > 1000 else 150)
    texts = [prose(rng, 60) + shared + prose(rng, 40), shared[: len(shared) * 4 // 5] + prose(rng, 5), prose(rng, 300), "ab",
             "", shared[37:], prose(rng, 10)]
    if length < 10:     # everything repeats
        texts = [t[:60] for t in texts]
    rows = [(i // 3, t) for i, t in enumerate(texts)]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), length).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in found) == Counter(
        (i, len(t), n) for (i, t), n in zip(rows, covered(texts, length)))


def test_lengths_out_of_range_are_refused(spark):
    for length in (1, 1 << 16):
        with pytest.raises(ValueError, match="bytes"):
            suffix_dedup.remove_repeats(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), length)


def test_a_string_that_most_documents_repeat_is_dealt_to_several_tasks(spark, monkeypatch):
    plans, stage = {}, suffix_dedup.stage

    def staged(df, name):
        df.collect()
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, name)

    monkeypatch.setattr(suffix_dedup, "stage", staged)
    settings = {"autoBroadcastJoinThreshold": "-1", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
                "adaptive.skewJoin.skewedPartitionFactor": "1.5", "adaptive.advisoryPartitionSizeInBytes": "1k"}
    before = {f"spark.sql.{k}": spark.conf.get(f"spark.sql.{k}") for k in settings}
    rng = random.Random(3)
    rows = [(i, "-" * 900 + prose(rng, 60)) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    try:
        for k, v in settings.items():
            spark.conf.set(f"spark.sql.{k}", v)
        found = suffix_dedup.remove_repeats(docs).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "skew=true" in plans["anchors-repeated"]
    assert sorted((r["doc_id"], r["n_removed"]) for r in found) == [
        (i, n) for (i, _), n in zip(rows, covered([t for _, t in rows], 400))]


def test_one_of_each_where_ids_are_shared(spark):
    rng = random.Random(5)
    text, other, third = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    near = text.rsplit(" ", 1)[0] + " end"
    rows = [(1, text), (2, text), (2, other), (2, other), (3, near), (4, third), (4, third), (None, text), (5, None), (5, ""), (6, None)]
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows],
                               "doc_id bigint, text string, dropped_id string, `Dropped_Digest` string, repeated_id string")
    kept = ngram_join.keep_one_of_each(df)
    assert kept.columns == df.columns
    found = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert found[2, other] == 1 and found[1, text] == 1 and found[None, text] == 1 and found[4, third] == 1
    assert (2, text) not in found and (3, near) not in found
    assert sum(found.values()) == 7 and found[6, None] == found[5, None] == found[5, ""] == 1     # no words, no links


def pages(rng, n, host, line, own):
    return [(i, f"{prose(rng, own)}\n{line}\n{prose(rng, own)}", host) for i in range(n)]


def test_boilerplate_goes_from_texts_and_depleted_documents_go(spark):
    rng = random.Random(6)
    line = "Subscribe to our letter and  read more every day"
    rows = pages(rng, 30, "h1", line, 20) + [(100 + i, t, h) for i, t, h in pages(rng, 5, "h2", line, 20)]
    rows += [(200, f"{line}\n{line.upper()}\n{line}\nfew own words", "h1"), (201, prose(rng, 40), "h1"), (202, None, "h1"),
             (203, "too few", None), (100, f"another text\n{line}\n{prose(rng, 30)}", "h1")]
    df = spark.createDataFrame([(i, t, h, "x", "y", "z") for i, t, h in rows],
                               "doc_id bigint, text string, source string, judged_id string, `Rejected_Id` string, judged_lines string")
    good = quality.keep_good(df)
    assert good.columns == df.columns
    texts = {(r["doc_id"], r["source"]): r["text"] for r in good.collect()}
    assert set(texts) == {(i, h) for i, t, h in rows} - {(200, "h1"), (202, "h1"), (203, None)}
    assert all(line not in t for (i, h), t in texts.items() if h == "h1")
    assert all(line in t for (i, h), t in texts.items() if h == "h2")        # five pages are too few
    before = dict(((i, h), t) for i, t, h in rows)
    assert all(t == before[k].replace(f"{line}\n", "") or k[1] == "h2" for k, t in texts.items())


def test_a_line_to_fill_in_is_no_secret(spark):
    text = "Password: ________ please fill in\ntoken=--------//++\npwd: ____-___x"
    new, n = pii.replace_entities(text, b"key")
    assert n == 1 and new.startswith("Password: ________ please fill in\ntoken=--------//++\npwd: ____-___")
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert pii.replace_pii(docs, b"key").first()["n_entities"] == 1


def test_every_kind_ends_where_its_shape_is_used_up(spark):
    rng = random.Random(8)
    forms = [("secret", f"_______{c}") for c in string.ascii_lowercase + string.digits]
    forms += [("secret", "".join(rng.choice("ab_+/-") for _ in range(8)) + "a") for _ in range(200)]
    forms += [("phone", f"0{i:07d}") for i in range(300)] + [("social", f"{i:09d}") for i in range(300)]
    forms += [("card", f"4{i:012d}") for i in range(300)] + [("iban", f"DE{i % 100:02d}{i:018d}") for i in range(300)]
    forms += [("access_key", "A" * 16), ("ip", "1.1.1.1"), ("ip", "2001:db8::1"), ("email", "a@b.cd"), ("family:latin", "smith")]
    found = spark.createDataFrame(sorted(set(forms)), "kind string, form string")
    chosen = pii.choose_surrogates(found, b"key").toPandas()
    assert len(chosen) == len(set(forms)) and not chosen.duplicated(["kind", "new"]).any()
    assert not set(zip(chosen["kind"], chosen["new"])) & set(forms)


def test_numbers_keep_their_checks_and_new_kinds_are_found():
    text = "DE89 3704 0044 0532 0130 00, 2001:0db8:85a3:0:0:8a2e:0370:7334, fe80::1, 030 1234567 at 12:30:45"
    found = pii.mentions(text)
    assert [m.kind for m in found] == ["iban", "ip", "ip", "phone"]
    new = pii.surrogate(b"key", "iban", "DE89370400440532013000")
    assert pii.iban_check("DE89370400440532013000") == "89" and pii.iban_check(new) == new[2:4]
    assert pii.surrogate(b"key", "ip", "fe80::1").count(":") == 2 and len(pii.surrogate(b"key", "phone", "0301234567")) == 10
