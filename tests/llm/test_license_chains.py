import itertools
import random

from corvane.llm import licenses


def best_by_trying(matches, gap):
    """The most words that any subset of matches covers in order, by trying all."""
    most = 0
    for n in range(1, len(matches) + 1):
        for chain in itertools.combinations(matches, n):
            words, sound = chain[0][2], True
            for (ls, lt, lsize), (s, t, size) in itertools.pairwise(chain):
                over = max(0, ls + lsize - s, lt + lsize - t)
                sound &= over < size and s + over <= ls + lsize + gap and t + over <= lt + lsize + gap
                words += size - over
            if sound:
                most = max(most, words)
    return most


def test_chains_cover_the_most():
    rng = random.Random(3)
    for _ in range(300):
        matches = sorted({(rng.randint(0, 40), rng.randint(0, 30), rng.randint(2, 9)) for _ in range(rng.randint(0, 9))})
        score, before = licenses.chained(matches, 6)
        assert max(score, default=0) == best_by_trying(matches, 6)
        assert all(b < i for i, b in enumerate(before))


def test_a_chain_skips_a_match_that_a_greedy_one_would_take():
    # The second match is far on in the template, so that nothing could follow it.
    matches = [(0, 0, 10), (12, 90, 5), (18, 12, 30)]
    assert licenses.chained(matches, 100)[0][2] == 40


def test_copies_of_a_notice_are_spans_of_their_own():
    scanner = licenses.Scanner()
    notice = licenses.TEMPLATES["mit"][0]
    n = len(licenses.words(notice.encode()))
    for between in (" ", " and then again ", " x" * 40 + " "):
        spans = [s for s in scanner.scan((notice + between + notice).encode())["spans"] if s[0] == "mit"]
        assert [s[3] for s in spans] == [1.0, 1.0]
        assert spans[0][1:3] == (0, n) and spans[1][2] - spans[1][1] == n


def test_a_notice_with_words_put_in_and_left_out():
    scanner = licenses.Scanner()
    own = licenses.TEMPLATES["apache"][1].split()
    torn = own[:12] + ["really", "truly"] + own[12:20] + own[24:]
    (span,) = [s for s in scanner.scan(" ".join(torn).encode())["spans"] if s[0] == "apache"]
    assert span[1] == 0 and 0.85 < span[3] < 1


def test_many_copies_end_soon():
    scanner = licenses.Scanner()
    text = " ".join([licenses.TEMPLATES["mit"][0]] * 2000)
    assert len(scanner.scan(text.encode())["spans"]) == 2000


def maximal_matches(text, sequence, least):
    """(text start, template start, words) of all runs that neither side extends, by trying all pairs."""
    out = []
    for i, j in itertools.product(range(len(text)), range(len(sequence))):
        if text[i] == sequence[j] and not (i and j and text[i - 1] == sequence[j - 1]):
            n = 0
            while i + n < len(text) and j + n < len(sequence) and text[i + n] == sequence[j + n]:
                n += 1
            if n >= least:
                out.append((i, j, n))
    return sorted(out)


def test_each_template_has_all_its_matches():
    rng = random.Random(8)
    for _ in range(150):
        vocabulary = ["w%d" % i for i in range(rng.randint(2, 5))]
        line = lambda most: [rng.choice(vocabulary) for _ in range(rng.randint(1, most))]
        templates = [line(14) for _ in range(rng.randint(1, 5))]
        scanner = licenses.Scanner(least=3, templates=(("x", tuple(map(" ".join, templates))),))
        text = line(40)
        if rng.random() < 0.5:
            text[len(text) // 2 : len(text) // 2] = rng.choice(templates)
        own = [w.encode() for w in text]
        found = {}
        numbers = [scanner.automaton.number.get(w, 0) for w in own]
        if all(numbers):
            scanner._run(numbers, 0, [], found)
            for t, sequence in enumerate(templates):
                assert sorted(found.get(t, [])) == maximal_matches(text, sequence, 3)


def test_a_longer_run_of_another_template_hides_nothing():
    words = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen"]
    scanner = licenses.Scanner(templates=(("short", (" ".join(words),)), ("long", (" ".join(["zero", *words[:12], "other"]),))))
    got = scanner.scan(" ".join(["zero", *words[:12]]).encode())
    assert {s[0] for s in got["spans"]} == {"short", "long"}


def test_templates_are_data(spark):
    df = spark.createDataFrame([(1, "you may use this freely for any good purpose at all"), (2, "MIT license")], "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan(df, {"own": ["You may use this freely, for any good purpose at all."]}).collect()}
    assert rows[1].labels == "own" and rows[1].score == 1.0 and rows[2].labels == "mit"
