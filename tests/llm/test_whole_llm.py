"""Results that a shortcut would change without an error."""

import numpy as np

from tagweave.llm import html_text, substring


def test_pages_of_a_host_are_counted_over_its_shards(spark):
    """Blocks on 2 and 3 pages of a host, long and short, and one covered only by runs of two others."""
    rare, often = "these words stand on two pages only and therefore they stay", "these other words stand on three pages and therefore they must go"
    left, right = "alpha beta gamma delta epsilon zeta eta theta iota", "one two three four five six seven eight nine"
    rows = []
    for i in range(24):
        blocks = [f"own text number {i} differs in each of them and stays {i} as it is"]
        blocks += [rare, "short rare"] * (i in (2, 17)) + [often, "short often"] * (i in (1, 9, 20))
        blocks += [left + " " + right] * (i == 5) + [left] * (i in (6, 13, 21)) + [right] * (i in (3, 12, 23))
        declared = f"<article><p>{often}</p></article>" if i == 22 else ""
        rows.append((i, f"http://h/{i}", "".join(f"<p>{b}</p>" for b in blocks) + declared))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one, many = ({r["page_id"]: r["text"] for r in html_text.main_text(df, shard_pages=n).collect()} for n in (2000, 2))
    assert one == many
    assert often not in many[9] and "short often" not in many[9] and often in many[22]
    assert rare in many[2] and "short rare" in many[17] and left not in many[6]


def test_minimizers_of_a_text_of_more_than_2_to_24_words():
    window = 20
    word = np.random.default_rng(4).integers(0, 1 << 62, (1 << 24) + 5000).astype(np.uint64)
    word[-1000:] = word[:1000]
    got = substring.minimizers(word, window)
    ahead = got - np.arange(len(word) - window + 1)
    assert ahead.min() >= 0 and ahead.max() <= window - substring.GRAM
    assert (got[-(1000 - window + 1) :] - got[: 1000 - window + 1] == len(word) - 1000).all()
