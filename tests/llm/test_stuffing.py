import base64
import quopri
import random
import time

import pytest

from tidemark.llm.bodies import own_body
from tidemark.llm.stuffing import normal, page_facts, page_scores, page_tokens, said_once, words_in_sentences

HEAD = "From: a@b.example\nTo: c@d.example\nSubject: x\nMIME-Version: 1.0\n"
PROSE = "I had a look at the table and it still does not agree with what you sent on Monday. Could you check it before Friday? The meeting depends on it, and nobody answered when I asked who would do it. "
RNG = random.Random(1)
WORDS = ["travel mug", "best price", "garden hose", "cheap watch", "phone case", "loan offer"]
STUFFED = ", ".join(RNG.choice(WORDS) for _ in range(90))
PUNCTUATED = " ".join(f"{RNG.choice(('best', 'cheap', 'new'))} travel mug {RNG.choice(WORDS)}{RNG.choice('.!?')} travel mug, {RNG.choice(WORDS)}." for _ in range(25))
LINKS = "\n".join(f"* https://shop{i}.example/p?id={i}" for i in range(20))
TAGS = " ".join("#" + RNG.choice(WORDS).title().replace(" ", "") for _ in range(40))
TABLE = "Positions we hold:\n\n" + "\n".join(f"Z{chr(65 + i % 26)}ABC  {i * 3.1:.2f}  +{i % 7}.{i % 10}3%  vol {i * 991}" for i in range(40))
ALERT = "WARN bar check\n" + "\n".join(f"{k}=ok" for k in ("worker", "queue", "depth", "late", "slot", "feed", "dup", "bars") * 6)
DIGEST = "Digest\n\n" + "\n".join(f"{i}. {PROSE[:84]}\n   https://mail.example/{i}" for i in range(12))


def plain(body, extra=""):
    return f"{HEAD}Content-Type: text/plain; charset=utf-8\n{extra}\n{body}"


def test_own_body_forms():
    q = quopri.encodestring("Grüße aus Köln.\n".encode()).decode()
    assert own_body(plain(q, "Content-Transfer-Encoding: quoted-printable\n")) == "Grüße aus Köln."
    b = base64.encodebytes("Grüße aus Köln.".encode()).decode()
    assert own_body(plain(b, "Content-Transfer-Encoding: base64\n")) == "Grüße aus Köln."
    assert own_body(plain("Mine.\n\nOn Monday, A B wrote:\n> theirs\n> more\n-- \nA B\nRoom 1")) == "Mine."
    assert own_body(plain("Mine.\n\n-----Original Message-----\nFrom: x\nSent: y\n\nTheirs.")) == "Mine."
    assert own_body(plain("Mine.\n______________________________\nThis mail is confidential.")) == "Mine."
    multi = f'{HEAD}Content-Type: multipart/mixed; boundary="bb"\n\n--bb\nContent-Type: text/html\n\n<html><style>p{{}}</style><p>Hi &amp; bye</p><blockquote>old</blockquote></html>\n--bb\nContent-Type: application/octet-stream\nContent-Disposition: attachment; filename=a\nContent-Transfer-Encoding: base64\n\nAAAA\n'
    assert own_body(multi) == "Hi & bye" and own_body(multi + "--bb--\n") == "Hi & bye"
    assert own_body(multi.replace("\n", "\r\n")) == "Hi & bye"
    assert own_body(None) == own_body("") == own_body(" \n ") == "" and own_body("no header at all") == "no header at all"


def test_normal_words():
    assert [normal(w) for w in ("c0ntract", "essay31", "3SSAY", "2008", "#Deal")] == ["contract", "essay", "essay", "2008", "deal"]


def test_own_words_stay():
    spam = "cheap watch cheap watch best price\ncheap watch deal watch"
    for rule in ("***", "____________"):
        assert "cheap watch" in own_body(plain(f"Hello.\n{rule}\n{spam}\n\nend"))
    assert own_body(plain("-----Original Message-----\nI wrote this line by hand.")).endswith("by hand.")
    long = "It was " + "quite a long way and " * 200 + "then we came home."
    assert words_in_sentences(long) == (len(long.split()), 0)
    assert own_body(plain("Mine.\n\nThis message is confidential and meant for the named recipients only.")) == "Mine."
    deep = "\n".join(f'--b{i}\nContent-Type: multipart/mixed; boundary="b{i + 1}"\n' for i in range(30)) + "\n--b30\nContent-Type: text/plain\n\ndown here\n"
    assert "down here" in own_body(f'{HEAD}Content-Type: multipart/mixed; boundary="b0"\n\n{deep}')
    assert own_body(f"{HEAD}Content-Type: text/html\n\n<html><p>{'x' * 5000}</p><{'y' * 5000}>end").endswith("end")


def test_one_message_in_two_forms_counts_once():
    both = f'{HEAD}Content-Type: multipart/mixed; boundary="bb"\n\n--bb\nContent-Type: text/plain\n\nSee you at the old bridge on Monday.\n--bb\nContent-Type: text/html\n\n<html><p>See you at the <b>old</b> bridge on Monday.</p></html>\n--bb--\n'
    assert own_body(both) == "See you at the old bridge on Monday."


@pytest.mark.parametrize("mark", ["<style>", "<blockquote>", "<a href=x>", "<", "<!--", "<div "])
def test_hostile_markup_takes_linear_time(mark):
    start = time.perf_counter()
    own_body(f"{HEAD}Content-Type: text/html\n\n<html>" + mark * 40_000)
    assert time.perf_counter() - start < 5


def test_sentences_said_again_count_once():
    again = "\n".join(f"We found {i} rows that the table has twice." for i in range(9))
    assert page_tokens(said_once(again))["rows"] == 1
    assert page_tokens(said_once("best watch, cheap watch. best watch, cheap watch. watch deal!"))["watch"] == 5


def test_facts_of_odd_texts():
    for t in (None, "", "   ", "\x00", "x" * 300_000, ("word " * 50_000), HEAD):
        page_facts(t)


def test_flags(spark):
    cases = [
        (1, plain(STUFFED), True), (2, plain("Let us talk about it soon, please.\n\n" + STUFFED), True), (3, plain(LINKS), True), (4, plain(TAGS), True),
        (5, plain(TABLE), False), (6, plain(ALERT), False), (7, plain(DIGEST), False), (8, plain(PROSE * 3), False), (9, plain("Look at what came today:\n\n> " + STUFFED.replace(", ", "\n> ")), False),
        (10, plain("essay 3ssay ESSAY essay31 cheap essay " * 20), True), (11, None, False), (12, "", False), (13, plain("done"), False), (14, plain(base64.encodebytes(STUFFED.encode()).decode(), "Content-Transfer-Encoding: base64\n"), True),
        (15, plain(PUNCTUATED), True), (16, plain("Let us talk about it soon, please.\n\n" + PUNCTUATED), True), (17, plain("\n".join(f"We found {i} rows that the table has twice." for i in range(9))), False),
        (14, plain(base64.encodebytes(STUFFED.encode()).decode(), "Content-Transfer-Encoding: base64\n"), True),
    ]
    prose = [(100 + i, plain(PROSE * (1 + i % 4)), False) for i in range(60)]
    df = spark.createDataFrame([(i, t, 0.5) for i, t, _ in cases + prose], "doc_id long, text string, slope double")
    got = page_scores(df).select("doc_id", "flagged").collect()
    assert len(got) == len(cases) + len(prose)
    want = {i: w for i, _, w in cases + prose}
    assert {r["doc_id"]: r["flagged"] for r in got} == want


def test_stuffed_sentences_of_one_length_set_no_range(spark):
    def stuffed(i):
        r = random.Random(i)
        return " ".join(f"{r.choice(('Best', 'Cheap', 'New'))} travel {r.choice(('mug', 'bag'))} and {r.choice(WORDS)}, {r.choice(WORDS)}{r.choice('.!?')}" for _ in range(25))

    rows = [(i, plain(PROSE * (1 + i % 4))) for i in range(300)] + [(1000 + i, plain(stuffed(i))) for i in range(40)]
    got = page_scores(spark.createDataFrame(rows, "doc_id long, text string")).where("flagged").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1000, 1040))


def test_empty(spark):
    assert page_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [40, 400])
def test_curve(spark, n):
    from tidemark.llm.stuffing import curves

    freq = [max(1, n // r) for r in range(1, n + 1)]
    levels = sorted(set(freq), reverse=True)
    df = spark.createDataFrame([(1, "en", levels, [freq.count(f) for f in levels])], "row long, lang string, freq array<int>, types_of array<int>")
    assert -1.15 < curves(df).first()["slope"] < -0.85
