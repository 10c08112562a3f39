"""The url models against exact counts of all contexts."""

import math
import random
from collections import Counter, defaultdict

from lintweave.llm import urls


def test_exact_contexts(spark):
    """Many more contexts than 16,384: scores are those of exact counts."""
    rnd = random.Random(4)
    name = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz-_~!") for _ in range(n))
    pages = [(i, f"http://{name(9)}.{('com', 'net/es', 'org')[i % 3]}/{name(24)}") for i in range(3000)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    coded = lambda r: "\n" * urls.ORDER + r.host + r.path + "\n"
    counts = {c: defaultdict(Counter) for c in ("allow", "block")}
    for r in got.values():
        if r.rule:
            t = coded(r)
            for i in range(urls.ORDER, len(t)):
                for k in range(urls.ORDER + 1):
                    counts[r.verdict][t[i - k : i]][t[i]] += 1
    assert len(counts["allow"]) + len(counts["block"]) > 50_000
    for r in list(got.values())[::60]:
        t, total = coded(r), 0.0
        for i in range(urls.ORDER, len(t)):
            p = {}
            for c, by in counts.items():
                p[c] = 1 / 256
                for k in range(urls.ORDER + 1):
                    if seen := by.get(t[i - k : i]):
                        p[c] = (seen[t[i]] + len(seen) * p[c]) / (seen.total() + len(seen))
            total += math.log(p["allow"]) - math.log(p["block"])
        assert abs(r.score - total / (len(t) - urls.ORDER)) < 2e-6
