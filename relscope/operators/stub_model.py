"""A deterministic local stand-in for a model server (tests and fixture queries).

It reads the item count from the prompt ("... exactly {n} objects ...") and
answers from the prompt's md5: item i gets label ``ord(hex[i % 32]) % 3``.
Prompts whose md5 starts with '0' fail on every try; with '1' the reply has
one item too many.  The same rule is plain SQL, so the DuckDB oracle can
reproduce every prediction.
"""

from __future__ import annotations

import hashlib
import re

_COUNT = re.compile(r"exactly (\d+) objects")


class StubModel:
    def __call__(self, prompt: str) -> str:
        h = hashlib.md5(prompt.encode("utf-8")).hexdigest()
        if h[0] == "0":
            raise RuntimeError("model unavailable")
        m = _COUNT.findall(prompt)
        n = int(m[-1]) if m else 0
        if h[0] == "1":
            n += 1
        strategy = _strategy(prompt)
        items = [_item(strategy, ord(h[i % 32]) % 3) for i in range(n)]
        return "[" + ", ".join(items) + "]"


def _strategy(prompt: str) -> str:
    if '"relevance": 0.00}' in prompt:
        return "D"
    if '"neither": 0}' in prompt:
        return "C"
    if '{"attack": 0, "support": 0}' in prompt:
        return "B"
    return "A"


def _item(strategy: str, label: int) -> str:
    a = int(label == 0)
    if strategy == "A":
        return f'{{"attack": {a}}}'
    if strategy == "B":
        return f'{{"attack": {a}, "support": {1 - a}}}'
    s, n = int(label == 1), int(label == 2)
    if strategy == "C":
        return f'{{"attack": {a}, "support": {s}, "neither": {n}}}'
    return f'{{"attack": {a}, "support": {s}, "neither": {n}, "relevance": {label * 0.25}}}'


def stub_factory() -> StubModel:
    return StubModel()
