"""The url models against plain counts of whole contexts."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import pytest

from plumbline.llm import urls


def test_scores_equal_exact_counts_on_many_contexts(spark):
    random.seed(9)
    name = lambda n: "".join(random.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    rows = [(i, f"http://{name(9)}.org/fr/{name(20)}" if i % 2 else f"http://{name(9)}.net/{name(20)}") for i in range(2500)]
    rows += [(5000 + i, f"http://{name(9)}.com/{name(20)}") for i in range(50)] + [(6000, None), (6001, "http://ä.com/x")]
    seen = (Counter(), Counter())

    def steps(url):
        data = b"\x02" * 5 + (url or "").encode() + b"\x03"
        for at in range(5, len(data)):
            yield [(data[at - n:at], data[at:at + 1]) for n in range(6)]
    for _, url in rows[:2500]:
        if zlib.crc32(url.encode()) % 5:
            for step in steps(url):
                for context, byte in step:
                    seen[".net/" in url][(context,)] += 1
                    seen[".net/" in url][(context, byte)] += 1
    assert len(seen[0]) + len(seen[1]) > 1 << 16

    def score(url):
        logs = []
        for step in steps(url):
            p = [1 / 256, 1 / 256]
            for context, byte in step:
                p = [(seen[k][(context, byte)] + 2 * p[k]) / (seen[k][(context,)] + 2) for k in (0, 1)]
            logs.append(math.log(p[1]) - math.log(p[0]))
        return sum(logs) / len(logs)
    pages = spark.createDataFrame(rows, "page_id long, url string")
    found = {r.page_id: r.score for r in urls.judged(pages).collect()}
    assert len(found) == len(rows)
    assert all(found[i] == pytest.approx(score(url), abs=1e-9) for i, url in rows)
