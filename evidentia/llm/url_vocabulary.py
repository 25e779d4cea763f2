"""The vocabulary of the URL filter: weighted terms of four languages, their forms by rule, and compounds."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import combinations

import ahocorasick
from pyspark.sql import DataFrame

#: One of these rejects, by language.
STRICT_TERMS = {
    "en": ("casino", "porn", "porno", "xxx", "viagra", "cialis", "sexcam", "sexchat", "escort", "jackpot", "malware", "phishing", "warez", "spam", "roulette", "blackjack", "keygen", "nudes", "hentai", "milf", "camgirl", "hookup", "sportsbook", "bookmaker", "tramadol", "botnet", "hardcore"),
    "es": ("tragaperras", "ruleta", "apuesta", "pornografia", "putas"),
    "fr": ("pornographie", "libertin", "parieur", "tiercé"),
    "de": ("spielautomat", "wettbüro", "pornografie", "glücksspiel", "potenzmittel"),
}
#: Several different ones of these reject.
SOFT_TERMS = {
    "en": ("cheap", "pill", "pharmacy", "loan", "payday", "bonus", "win", "winner", "winning", "free", "bet", "betting", "poker", "slot", "dating", "adult", "replica", "discount", "crack", "cracked", "torrent", "clickbait", "seo", "backlink", "farm", "lottery", "sexy", "sex", "nude", "gambling", "gamble", "bingo", "wager", "weightloss", "forex", "bitcoin", "crypto", "refinance", "mortgage", "coupon", "ringtone", "freebie", "ads", "track", "tracker", "popup", "banner", "affiliate", "erotic", "fetish", "webcam", "singles"),
    "es": ("gratis", "barato", "farmacia", "préstamo", "prestamo", "descuento", "pastilla", "lotería", "loteria", "citas", "ganar"),
    "fr": ("gratuit", "pharmacie", "rencontre", "pilule", "loterie", "rabais", "gagner", "érotique"),
    "de": ("kostenlos", "billig", "apotheke", "kredit", "rabatt", "pille", "lotto", "gewinn", "gewinnspiel", "wetten", "erotik"),
}
#: Words that stand beside terms in compounds, such as the names of hosts, and say nothing themselves. Single digits do, too.
LINKS = ("hub", "tube", "cam", "cams", "chat", "online", "live", "site", "club", "world", "zone", "land", "king", "best", "top", "my", "the", "your", "net", "web", "shop", "store", "now", "app", "mobile", "video", "videos", "movie", "movies", "pics", "hd", "vip", "pro", "hot", "room", "house", "city", "guide", "reviews", "deals", "official", "for", "you", "and", "of", "game", "games", "play", "star", "real", "super", "mega", "easy", "fast", "buy", "get", "all", "express", "finder", "lovers")
#: Endings of plurals, by language.
ENDINGS = {"en": ("s", "es"), "es": ("s", "es"), "fr": ("s", "x"), "de": ("s", "n", "en", "e")}
#: Letters that are written as digits to get past filters.
DISGUISES = {"o": "0", "i": "1", "e": "3", "a": "4"}
#: A vocabulary that is read from a table has no more forms than that: every task holds it.
MOST_FORMS = 500_000


@dataclass(frozen=True)
class Vocabulary:
    """forms: how a term is written, to (term, whether it is strict). With compounds, a form also counts inside a run
    of letters and digits that is made of forms, links and digits alone (freecasino, pornhub); without, only as a whole."""

    forms: dict[str, tuple[str, bool]]
    links: frozenset[str] = frozenset()
    compounds: bool = False

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        pieces = dict.fromkeys((*self.links, *"0123456789"), None) if self.compounds else {}
        for form, term in (pieces | self.forms).items():
            found.add_word(form, (len(form), term))
        found.make_automaton()
        return found


def as_listed(strict: Sequence[str], soft: Sequence[str]) -> Vocabulary:
    """The terms as they are, each of them its only form."""
    return Vocabulary({t.lower(): (t.lower(), False) for t in soft} | {t.lower(): (t.lower(), True) for t in strict})


def forms_of(term: str, language: str) -> set[str]:
    """A term, its plurals, and each of them with one or several kinds of letters written as digits."""
    plain = {term, *(term + e for e in ENDINGS.get(language, ()))}
    kinds = [c for n in range(len(DISGUISES) + 1) for c in combinations(DISGUISES, n)]
    return {form.translate(str.maketrans({k: DISGUISES[k] for k in kind})) for form in plain for kind in kinds}


def weighted(rows: Iterable[tuple[str, str, bool]], links: Iterable[str] = LINKS) -> Vocabulary:
    """Rows of term, language and whether it is strict, with all their forms and compounds. A form of several terms is
    a listed term's before a derived one's, then a strict one's, then that of the first in order."""
    ranked = sorted((form != term.lower(), not strict, term.lower(), form) for term, language, strict in rows for form in forms_of(term.lower(), language))
    forms: dict[str, tuple[str, bool]] = {}
    for _, soft, term, form in ranked:
        forms.setdefault(form, (term, not soft))
    return Vocabulary(forms, frozenset(x.lower() for x in links) - forms.keys(), compounds=True)


def standard() -> Vocabulary:
    kinds = ((STRICT_TERMS, True), (SOFT_TERMS, False))
    return weighted((t, language, strict) for terms, strict in kinds for language, listed in terms.items() for t in listed)


def from_table(terms: DataFrame, links: Iterable[str] = LINKS) -> Vocabulary:
    """The vocabulary of a table: term, language, strict. Rows without a term are left out, a null language has no
    plurals, null is not strict. Its rows are counted first; one too large for a task is refused, never cut."""
    named = terms.where("trim(term) <> ''").selectExpr("lower(trim(term)) AS term", "coalesce(language, '') AS language", "coalesce(strict, false) AS strict").distinct()
    n = named.count()
    if n > MOST_FORMS // 50:  # a term has at most 16 disguises of each of five forms, and fewer than 50 on average
        raise ValueError(f"a vocabulary of {n} terms is too large to be held by every task")
    found = weighted(((r.term, r.language, r.strict) for r in named.collect()), links)
    if len(found.forms) > MOST_FORMS:
        raise ValueError(f"a vocabulary of {len(found.forms)} forms is too large to be held by every task")
    return found
