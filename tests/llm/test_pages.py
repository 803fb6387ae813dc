"""Page differencing against a naive one, words that mark nothing, and pages that would make a scanner crawl."""

import random
import time

import pytest

from motiondeck.llm import align, page_diff


def kept(page):
    return "\n".join(x for x, r in page_diff.lines_of(page) if r in (page_diff.MAIN, page_diff.OPEN))


@pytest.mark.parametrize("inside", ["<section id=discussion>K</section>", "<section id=social-history>K</section>", "<h2 id=related-work>K</h2>", "<div class=cookie-recipe>K</div>", "<p class=share-price>K", "<p class=modal-verbs>K", "<div class='wp-block comments-open'>K</div>"])
def test_words_within_other_names_mark_nothing(inside):
    assert kept(f"<article>{inside}</article>") == "K"


@pytest.mark.parametrize("other", ["<article class=comment>K</article>", "<article class='ad box'>K</article>", "<article role=complementary>K</article>", "<div class=related-posts>K</div>", "<div id=cookie-banner>K</div>", "<ul class='social-links'><li>K</ul>", "<div class=share_buttons>K</div>", "<section id=comments-area>K</section>", "<div class='ad-slot top'>K</div>"])
def test_comments_adverts_and_asides_go(other):
    assert kept(f"<article>T</article>{other}") == "T" and kept(f"<main><p>T</p>{other}</main>") == "T"


@pytest.mark.parametrize("bad", ["<p ", "<a b='", '<a b="x>', "<a b='>", "</z>", "<!-- ", "<![CDATA[", "<i '>", "<title>x", "<script ", "<div>", "<td>", "<li><p>", "<", "<a href=>", "&", "<p>x</q>"])
def test_unclosed_markup_takes_linear_time(bad):
    start = time.perf_counter()
    page_diff.lines_of(bad * (400_000 // len(bad)))
    assert time.perf_counter() - start < 4


def test_quotes_that_nothing_ends_hide_nothing():
    assert kept("<p title='it>A</p><p>B") == "A\nB" and kept("<a href=\"x>y\">A</a>") == "A" and kept("a < b <c") == "a < b <c"


def lcs(a, b):
    best = [[[] for _ in range(len(b) + 1)] for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = [(i, j), *best[i + 1][j + 1]] if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1], key=len)
    return best[0][0]


def brute(rows):
    """Every page held against its neighbours by (host, path, page_id), line by line."""
    found = {}
    parsed = sorted((*page_diff.url_key(u), i, page_diff.lines_of(h)) for i, u, h in rows)
    for k, (host, _, i, lines) in enumerate(parsed):
        shared = set()
        for other in (parsed[k - 1] if k else None, parsed[k + 1] if k + 1 < len(parsed) else None):
            if other is None or other[0] != host:
                continue
            pairs = lcs([x for x, _ in lines], [x for x, _ in other[3]])
            if 2 * sum(len(lines[p][0]) for p, _ in pairs) > sum(len(x) for x, _ in lines) and 2 * sum(len(other[3][q][0]) for _, q in pairs) > sum(len(x) for x, _ in other[3]):
                continue
            shared |= {p for p, _ in pairs}
        text = [x for n, (x, r) in enumerate(lines) if r == page_diff.MAIN or r == page_diff.OPEN and n not in shared]
        found[i] = "\n".join(text or [x for n, (x, r) in enumerate(lines) if r == page_diff.SIDE and n not in shared])
    return found


def test_extraction_is_that_of_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        host = rng.choice(["a.b", "a.b", "c.d", "E.f"])
        top, bottom = [f"<div>{host} {k} menu of this site</div>" for k in range(3)], f"<div>all rights of {host}</div>"
        top = sorted(rng.sample(top, rng.randint(1, 3)))  # in one order everywhere, so there is one longest subsequence
        own = "".join(f"<p>{' '.join(f'own{i}{k}{j}' for j in range(9))}</p>" for k in range(rng.randint(0, 4)))
        body = rng.choice([own, f"<article>{own}</article>", f"<div class=search-results>{own}</div>"])
        rows.append((i, f"http://{host}/{rng.randrange(40)}/x", f"{''.join(top)}<nav>n</nav>{body}{bottom}"))
    rows += [(200 + k, "http://c.d/copy", rows[3][2]) for k in range(3)] + [(300 + k, f"http://s.t/{k}", f"<div class=header>same top</div><div class=search-results>hit {k} of a longer line</div>") for k in range(3)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    expected = brute(rows)
    for options in ({}, {"sample": 40, "range_bytes": 500}):
        found = {r.page_id: r.text for r in page_diff.extract(df.repartition(5), **options).collect()}
        assert found == expected
    assert expected[300] == "hit 0 of a longer line"


@pytest.mark.parametrize("seed", range(8))
def test_long_common_subsequences_need_little_memory(seed):
    rng = random.Random(seed)
    a, b = ([rng.randint(0, 40) for _ in range(rng.randint(0, 400))] for _ in range(2))
    one, two = align.common(a, b)
    assert [a[i] for i in one] == [b[j] for j in two] and one == sorted(set(one)) and two == sorted(set(two))
    before = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[-1]))
        before = row
    assert len(one) == before[-1]


def test_pages_of_many_shared_lines_in_another_order():
    import tracemalloc

    a = list(range(12_000))
    b = a[:]
    random.Random(5).shuffle(b)
    tracemalloc.start()
    try:
        one, _ = align.common(a, b)
        assert tracemalloc.get_traced_memory()[1] < 40e6 and 150 < len(one) < 300
    finally:
        tracemalloc.stop()
