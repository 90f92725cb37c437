"""Errors of the language and of execution, with hints and a caret rendering."""

from __future__ import annotations


class QueryError(Exception):
    """A query that can't be parsed or analysed. ``code`` is E000 to E011."""

    def __init__(self, code: str, message: str, at: int | None = None, hint: str | None = None) -> None:
        super().__init__(f"{code}: {message}" + (f" ({hint})" if hint else ""))
        self.code, self.message, self.at, self.hint = code, message, at, hint

    def render(self, text: str) -> str:
        """The message above the line it is about, with a caret under the place."""
        out = [f"error[{self.code}]: {self.message}"]
        if self.at is not None:
            start = text.rfind("\n", 0, self.at) + 1
            end = text.find("\n", self.at)
            line = text[start : end if end >= 0 else len(text)]
            number = text.count("\n", 0, self.at) + 1
            out += [f" --> {number}:{self.at - start + 1}", f"  | {line}", "  | " + " " * (self.at - start) + "^"]
        if self.hint:
            out.append(f"  = help: {self.hint}")
        return "\n".join(out)


class EngineError(Exception):
    """A query that can't be run. ``kind`` names the reason."""

    def __init__(self, kind: str, message: str) -> None:
        super().__init__(f"{kind}: {message}")
        self.kind = kind


def distance(a: str, b: str) -> int:
    """Edits (insert, delete, replace) between two words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def suggest(word: str, known) -> str | None:
    """The known name that shares most parts between underscores with ``word``, then the one with fewest edits, three at most if no part is shared."""
    parts = set(filter(None, word.split("_")))
    ranked = [(-len(parts.intersection(k.split("_"))), distance(word, k), k) for k in known]
    shared, edits, name = min(ranked, key=lambda r: r[:2], default=(0, 4, None))
    return f"did you mean `{name}`?" if shared or edits <= 3 else None
