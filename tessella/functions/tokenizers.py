"""Tokenizers as expressions: text column to an array of (term, position), all in the JVM."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default stop words.
ENGLISH = frozenset("a about above after again all an and any are at be been before being below both but by can don down each few for from further he her here his how i in is it its just more most my no nor not now of on once only or other our out over own s same she should so some such t than that the their them then there these they those to too under up very was we were when where why will with you your".split())
CHINESE = frozenset("一 一个 上 不 也 了 人 什么 他 他们 会 但是 你 你们 到 去 只是 可以 和 因为 在 她 好 如何 它 就 很 您 我 我们 所以 是 有 没有 的 看 着 自己 要 说 这 这些 这样 那 那些 那样 都".split())

#: A run of other than white space without the punctuation at its ends, in one pass and without empty finds.
_TRIMMED = r"(?U)[^\s\p{P}](?:\S*[^\s\p{P}])?"
_LETTERS_OR_NUMBERS = r"(\p{L}+|\p{N}+)"
_WITH_PUNCTUATION = r"""(\p{L}+|\p{N}+|[.,!?;:'"()\[\]{}])"""
_CHINESE = r"(\p{IsHan}|\p{Nd}+|[^\s\p{P}\p{S}\p{Nd}\p{IsHan}]+)"


@dataclass(frozen=True)
class Tokenizer:
    """name: simple (white space, outer punctuation trimmed), unicode (runs of letters or of numbers) or chinese
    (single Han characters, runs of others)."""

    name: str = "simple"
    stop_words: frozenset[str] = ENGLISH | CHINESE
    case_sensitive: bool = False
    numbers: bool = True
    punctuation: bool = False

    def with_stop_words(self, add: Iterable[str] = (), remove: Iterable[str] = ()) -> Tokenizer:
        return replace(self, stop_words=(self.stop_words | frozenset(add)) - frozenset(remove))

    def raw(self, text: Column) -> Column:
        text = F.coalesce(text, F.lit(""))
        if self.name == "simple":
            return F.regexp_extract_all(text, F.lit(_TRIMMED), 0)
        if self.name == "unicode":
            return F.regexp_extract_all(text, F.lit(_WITH_PUNCTUATION if self.punctuation else _LETTERS_OR_NUMBERS), 1)
        return F.regexp_extract_all(text, F.lit(_CHINESE), 1)

    def terms(self, text: Column) -> Column:
        """The kept terms in order."""
        if self.name == "simple" and not self.case_sensitive:
            # White space and punctuation have no case, so the whole text is lower-cased at once; what a capital sigma
            # becomes depends on letters of its own run alone.
            found = self.raw(F.lower(text))
        else:
            found = self.raw(text) if self.case_sensitive else F.transform(self.raw(text), F.lower)
        return F.filter(found, self._kept) if self.stop_words or not self.numbers else found

    def _kept(self, t: Column) -> Column:
        keep = ~t.isin(*sorted(self.stop_words)) if self.stop_words else F.lit(True)
        return keep if self.numbers else keep & ~t.rlike(r"^\p{N}+$")

    def tokens(self, text: Column) -> Column:
        """array of (term, pos). Dropped tokens leave no gap, but in chinese, where positions count all of them."""
        if self.name != "chinese":
            return F.transform(self.terms(text), lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
        found = self.raw(text) if self.case_sensitive else F.transform(self.raw(text), F.lower)
        return F.filter(F.transform(found, lambda t, i: F.struct(t.alias("term"), i.alias("pos"))), lambda x: self._kept(x["term"]))


def token_type(term: Column) -> Column:
    return F.when(term.rlike(r"^[0-9.+-]*[0-9][0-9.+-]*$"), "number").when(term.rlike(r"^[\p{P}\p{S}]+$"), "symbol").when(term.rlike(r"^\p{IsHan}+$"), "chinese").otherwise("word")


SIMPLE = Tokenizer()
UNICODE = Tokenizer("unicode", ENGLISH)
CHINESE_CHARS = Tokenizer("chinese", ENGLISH | CHINESE)
