"""Problem 10: personal information inside free text.

Weak-supervision aggregation. Patterns propose spans; labelers (shape, cue words before and
after, gazetteer, structure, neighbourhood) vote on each span for, against or not at all.
Expectation-maximisation over the counts of vote patterns of the whole corpus estimates how
reliable each labeler is, without labels; the posteriors train a logistic span classifier,
which decides.

Spark plan: one map over the texts yields candidates (about 0.1 kB each) that are checkpointed;
the vote patterns are counted with a map-side combine and at most 3**LABELERS of them per type
reach the driver, whatever the corpus; the classifier is fitted on a sample of bounded size
(``train_rows``) and scores every candidate in a map. Texts are read whole and never shuffled.

Defined results: null and empty texts have no spans and come out as they are; texts without an id
are redacted but not reported; equal spans of a document are reported once, under the likeliest
type.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limpid.session import written

try:
    import ahocorasick
except ImportError:  # then the words are searched one by one
    ahocorasick = None

TYPES = ("email", "phone", "id_number", "address", "name")
LABELERS = 6
BUCKETS = 128
#: Candidates on which the classifier is fitted, at most; chosen by hash over all of them.
TRAIN_ROWS = 20_000

# ---------------------------------------------------------------- patterns

#: Capital letters: Latin, Greek, Cyrillic and Armenian.
_U = "A-ZΆΈ-ΏΑ-ΫЀ-ЯѠҐԱ-ՖÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĴĶĹĻĽĿŁŃŅŇŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽ"
_DOMAIN = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")
#: "at" in brackets before any domain, or plain before a domain that is spelt out too.
_SPELT = re.compile(
    r"([\w.+-]*[\w+])(?: ?(?:\(at\)|\[at\]|\{at\}) ?([^\W_][\w-]*(?:(?:\.| dot | ?\(dot\) ?| ?\[dot\] ?)[^\W_][\w-]*)+)"
    r"| at ([^\W_][\w-]*(?:(?: dot | ?\(dot\) ?| ?\[dot\] ?)[^\W_][\w-]*)+))", re.I
)
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.+-_%")

#: Cheap first pass: characters of which numbers consist.
_NUMBER_RUN = re.compile(r"[+(\d][\dA-ZÑ ().\-/]{7,}")
_DIGIT = re.compile(r"\d")
_NUMBER = re.compile(
    r"[+(\d](?:"
    r"(?<=\+)\d{1,3}(?:[ .\-/]?\(?\d{1,5}\)?){2,6}"  # international
    r"|(?<=\()\d{2,5}\)[ \-]?\d{3,5}(?:[ \-]\d{2,5}){0,2}"  # (312) 555-0198
    r"|\d{7}-\d{4}"  # date of birth and serial
    r"|\d{7}[ -]?[A-ZÑ](?![\w])"  # eight digits and a check letter
    r"|\d[A-Z]{2}\d{5}"
    r"|\d{1,2}/\d{3}/\d{4,5}"
    r"| \d\d \d\d \d\d \d{3} \d{3}(?: \d\d)?"  # thirteen digits and key
    r"|\d{0,4}(?:(?:[ ./\-]|[ ./\-]?\(\d{1,5}\)[ ./\-]?)\d{1,8}){1,6}"  # grouped
    r"|\d{6,14}"
    r")"
)
_CODE = re.compile(r"[A-Z](?:[A-Z]{0,2}\d{6,8}[A-Z]?|[0-9A-Z]{8})(?![\w])")

_TITLE = r"(?:Mr|Mrs|Ms|Miss|Mme|Mlle|Dr|Prof|Frau|Herr|Herrn|Sr|Sra|Srta|Don|Doña|señora?|Sir|Madame|Monsieur)"
_W = rf"[{_U}][^\W\d_]*(?:['’][{_U}]?[^\W\d_]+)?"
_NAME_TAIL = re.compile(
    rf"(?:(?P<inv>, )(?P<given>{_W}|[{_U}]\.)"
    rf"|(?P<mid>(?: [{_U}]\.)*) (?P<fam>{_W}(?:-{_W})*))"
    rf"(?![\w(=\[]|\.\w|@)"
)
_NAME_HEAD = re.compile(rf"[{_U}](?:[^\W\d_]+(?:[-'’][^\W\d_]+)*|\.)(?=,? [{_U}])")

_ROAD = "Street|St\\.|Road|Rd\\.?|Lane|Ln\\.|Avenue|Ave\\.?|Drive|Dr\\.|Court|Ct\\.|Boulevard|Blvd\\.?|Square|Terrace|Close|Way|Place|Crescent|Row|Hill|Gardens|Parkway|Mews|Quay"
_TOWN = rf"[{_U}][^\W\d_]+(?:[ \-](?:[{_U}][^\W\d_]+|de|del|la|le|les|sur|sous|am|an|der|im|los|las|upon|on|en)){{0,3}}"
_ADDRESS = (
    re.compile(
        rf"(?P<num>(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Ste\.?|Room) \w{{1,5}},? )?\d{{1,5}}(?:[A-Za-z]|-\d+)?),? (?P<street>(?:[{_U}][\w'’.]*,? ){{1,4}}(?:{_ROAD}))(?P<unit>,? (?:Apt\.?|Flat|Apartment|Unit|Suite|Ste\.?|Floor|#) ?\w{{1,5}})?,? "
        rf"(?P<town>{_TOWN})(?:,? (?P<zip>(?:[A-Z]{{2}} )?\d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d[\dA-Z]? \d[A-Z]{{2}}))?"
    ),
    re.compile(
        rf"(?P<num>\d{{1,4}}(?: ?(?:bis|ter|[A-Da-d]))?),? (?P<street>(?:rue|avenue|av\.|boulevard|bd|chemin|place|impasse|allée|allées|quai|route|cours|square|passage|sentier|faubourg|Rue|Avenue|Boulevard|Chemin|Place|Allée|Quai|Route) (?:(?:de|du|des|de la|la|le|les|d'|de l'|l'|aux?|à) ?)*[{_U}][\w'’\-]*(?: [{_U}][\w'’\-]*)*)(?P<unit>,? (?:apt|appt|appartement|bât\.?|étage) ?\w{{1,4}})?,? (?:(?P<zip>\d{{5}}) )?(?P<town>{_TOWN})"
    ),
    re.compile(
        rf"(?P<street>(?:[{_U}][\w\-]*(?:stra(?:ß|ss)e|str\.|weg|gasse|platz|allee|ring|damm|ufer|steig|pfad|hof|markt|chaussee|graben)|(?:[{_U}][\w\-]+ )?(?:Straße|Strasse|Weg|Platz|Allee|Gasse|Ring)|(?:Am|An der|Im|Zum|Zur|Auf dem) [{_U}][\w\-]+)) (?P<num>\d{{1,4}} ?[A-Za-z]?)(?![\w])(?P<unit>)(?:,? (?P<zip>(?:D-)?\d{{5}}))?,? (?P<town>{_TOWN})"
    ),
    re.compile(
        rf"(?P<street>(?:Calle|C/|Avda\.?|Avenida|Av\.|Plaza|Pza\.|Paseo|P\.º|Camino|Ronda|Travesía|Carrera|Rúa|Carrer) ?(?:(?:de|del|de la|de los|de las|la|el|los|las) )*[{_U}][\w'’\-]*(?: (?:(?:de|del|la|y) )*[{_U}][\w'’\-]*)*),? (?:n\.?º ?)?(?P<num>\d{{1,4}} ?[A-Za-z]?)(?![\w])(?P<unit>,? \d{{1,2}}\.?[ºª°](?: ?[A-Za-z]{{1,4}})?\.?)?,? (?:(?P<zip>\d{{5}}),? )?(?P<town>{_TOWN})"
    ),
)
#: What every pattern above needs somewhere in its line.
_ROAD_WORDS = (
    " Street", " St.", " Road", " Rd", " Lane", " Ln.", " Ave", " Dr", " Court", " Ct.", " Boulevard", " Blvd", " Square", " Terrace", " Close", " Way", " Place", " Crescent", " Row", " Hill", " Gardens", " Parkway",
    " Mews", " Quay", "rue ", "avenue ", "av. ", "boulevard ", "bd ", "chemin ", " place ", "impasse ", "allée", "quai ", "route de", "route d", "cours ", "square ", "passage ", "sentier ", "faubourg ", "Rue ", "Avenue ",
    "Chemin ", "Allée ", "Quai ", "Route ", "straße ", "strasse ", "str. ", "weg ", "gasse ", "platz ", "allee ", "ring ", "damm ", "ufer ", "steig ", "pfad ", "hof ", "markt ", "chaussee ", "graben ", "Straße ", "Strasse ",
    "Weg ", "Platz ", "Allee ", "Gasse ", "Am ", "An der ", "Im ", "Zum ", "Zur ", "Auf dem ", "Calle ", "C/", "Avda", "Avenida ", "Plaza ", "Pza.", "Paseo ", "P.º", "Camino ", "Ronda ", "Travesía ", "Carrera ", "Carrer ", "Rúa ",
)
_HAS_NUMBER = re.compile(r"\b\d{1,5}[A-Za-z]?\b")
_ADDRESS_START = re.compile(rf"(?:Flat|Apt\.?|Apartment|Unit|Suite) \w{{1,5}},? (?=\d)")

# ---------------------------------------------------------------- cues (compared in lower case)

_CUE = {
    "phone": re.compile(r"(?:\btel|t[ée]l\b|phone|mobile|\bcell|\bcall|pager|\bfax|number is|reach (?:me|us|him|her)|joindre|llamar|r[üu]ckruf|tfno|desk|handy|hotline|whatsapp|sms|dial)[^\d]{0,32}(?:\b\d{1,3}\b[^\d\w]{1,6})?$"),
    "id_number": re.compile(r"(?:ssn|social.?security|s[ée]curit[ée] sociale|passport|passeport|pasaporte|reisepass|national|id.?card|id.?number|\bdni\b|\bnif\b|\bnie\b|ausweis|steuer|tax.?id|\btin\b|personal.?(?:id|n)|identity|personnummer|insee|\bcurp\b|\brecord\b)[^\d]{0,30}$"),
    "address": re.compile(r"(?:\bat\b|\bto\b|lives?|address|addr|street|home|office|ship|deliver|colis|domicile|livr|lieferung|wohn|adresse|anschrift|vive|entrega|direcci|domicilio|shows|residen)[^\d]{0,24}$"),
    "name": re.compile(
        rf"(?:(?:by|from|to|with|ask|thanks|cc|as|owner|author|reviewer|maintainer|name|contact|assignee|von|an|mit|par|à|avec|a|con|de|por|hi|dear|hello|user|customer|patient|employee|signed|{_TITLE.lower()[3:-1]})[\s:='\"(\[.<*_]{{1,6}}(?:(?:la|el|the) )?(?:{_TITLE.lower()}\.? )?)$"
    ),
    "email": re.compile(r"(?:<|mailto:|\bto\b|e-?mail|contact|from|kontakt|mail|owner at|write|escribir|[ée]crire|fragen|questions?|dudas|smtp|values|user|cc|reply|author|by)[^@]{0,24}$"),
}
_AGAINST_NUMBER = re.compile(r"(?:checksum|\bcrc|build|part no|part number|serial|sku|\blot\b|seed|\bts=|dur=|version|listen|\bport\b|uuid|commit|\bindex\b|hash|digest|offset|timeout|ticket|issue|\brev\b|order no|invoice|isbn|@@|\bv)[^\w]{0,4}$")
_AFTER_NUMBER = re.compile(r"^[\s;,)'\"]*(?:#|//|--)?\s*(?:not a|on node|ms\b|bytes|dur=|kb\b|mb\b|rows\b|entries\b|px\b)")
_AFTER_ID = re.compile(r"(?:social.?security|id number|identity|passport|tax number|s[ée]curit[ée] sociale|ausweis|dni\b|pasaporte|passeport|patient)")
_REMOTE = re.compile(r"(?:git |ssh |scp |rsync |sftp |clone|remote|origin)[^@]*$")
#: Fixed: words that open sentences, headings or code and are no part of a person's name.
_NOT_NAME = frozenset(
    """the this that these those see set each no not add fix make speed refactor document revert merge update remove drop use when where which what write explain assume if a an in on of for and or
    from to by with as is it we you he she they call reach mail sent questions contact desk their her his passport national record parcel lives ship order insert into values select create table
    begin end private public key fake binary files git patch subject author date commit release version build lane street road court avenue drive port saint san north south east west new old
    der die das ein eine für beim siehe vorgang prüfung fehler aufrufer neustart le la les un une des du voir aucun sin el los las véase corrige elimina mejora améliore supprime note todo none true
    false null string option result vec list return some match const let authorization bearer conflicts reported reviewed signed acked co tested thanks spoke ask mr mrs ms mme frau herr dr""".split()
)
#: Fixed: those that may open the name of a town.
_TOWN_OPENS = frozenset("port saint san north south east west new old le la les el los las the".split())
#: Fixed: common given names of many countries.
_GIVEN = frozenset(
    """aaron adam adele ahmed aino aisha alan alejandro alex alexander alice alina amara amina amir ana anders andrea andrei anita anna anne antonio anouk anton arjun astrid aya bea ben birgit bjorn
    boris bram carla carlos caio camila carmen cathy chen chiara chloe claire clara daan daniel dario david diego dmitri elena elif elin elsa emil emile emily emma erik esra eva fatima felix fiona
    francesca freya gabriel george giulia greta hana hannah hans haruto helen helga henrik hiro hugo ibrahim ida igor ilse imani ines ingrid irina isabel ivan jack jakub james jan jana jean jens
    joao johan john jonas jorge jose juan julia julie kai karim karin kate kenji kofi lars laura leila lena leo li lina linda lotte louis lucas lucia luis luka magda maja manuel marc marco marek
    maria marie mark marta martin mary mateo matteo max mehmet mia michael miguel mila mina mirela miriam mohamed nadia naledi natalia nico nils nina noor nora olga olu omar oscar paolo pablo paul
    pavel pedro peter petra pierre priya rachel rafael raj ravi rosa sakura sam sanne saoirse sara sergei simon sofia soren stefan susan svetlana tariq thomas tim tom tomas tomasz tove uma ursula
    valentina vera victor viktor wei will xin yara yuki yusuf zanele zoe""".split()
)


def _fold(text: str) -> str:
    text = unicodedata.normalize("NFKD", text.lower().replace("ø", "o").replace("ł", "l").replace("ß", "ss").replace("đ", "d"))
    return "".join(c for c in text if not unicodedata.combining(c))


_DENSE = re.compile(r"[^\s'\",:;\[\]\\]+")
_DENSE_END = re.compile(r"[^\s'\",:;\[\]\\]+\Z")


class _Line:
    """The context of spans of one line."""

    __slots__ = ("text", "begin", "end", "_loud")

    def __init__(self, text: str, begin: int, end: int):
        self.text, self.begin, self.end, self._loud = text, begin, end, None

    def before(self, at: int, n: int = 60) -> str:
        return self.text[max(self.begin, at - n) : at].lower()

    def after(self, at: int, n: int = 110) -> str:
        return self.text[at : min(self.end, at + n)].lower()

    def encoded(self, begin: int, end: int) -> bool:
        """Do encoded bytes stand around a span? A stretch of 40 characters or more without blanks or what divides values, other than in the span."""
        low, high = max(self.begin, begin - 60), min(self.end, end + 60)
        before, after = _DENSE_END.search(self.text, low, begin), _DENSE.match(self.text, end, high)
        return (end - begin) + len(before[0] if before else "") + len(after[0] if after else "") > (end - begin) + 40

    @property
    def loud(self) -> bool:
        """A line of four words or more in capitals throughout."""
        if self._loud is None:
            words = re.findall(r"[^\W\d_]{2,}", self.text[self.begin : self.end])
            self._loud = len(words) >= 4 and sum(w.isupper() for w in words) > 0.8 * len(words)
        return self._loud


_SHAPES = {
    "phone": (
        re.compile(r"\+\d{1,3}[ .\-]?\(?\d.*|00\d{2}[ .\-]?\(?\d.*"),
        re.compile(r"\(\d{2,5}\)[ \-]?\d{3,5}[ \-]?\d{2,5}|\d{3}[.\-]\d{3}[.\-]\d{4}|0\d{1,4}[ /\-]\d{3,5}[ \-]?\d{2,5}|0\d(?:[ .]\d\d){4}|0\d{2,4}/\d{5,8}|9\d\d[ \-]\d{3}[ \-]\d{3}|1[2-9]\d{9}|0\d{9,10}|[6789]\d{2}(?: \d{2}){3}"),
        re.compile(r"\d{3} \d{3} \d{4}|\d{10}"),
    ),
    "id_number": (
        re.compile(r"[A-Z]{1,3}\d{6,8}[A-Z]?|\d{2}[A-Z]{2}\d{5}|[A-Z](?=\w*\d)[0-9A-Z]{8}|\d{8}[ -]?[A-ZÑ]|[1-8] \d\d \d\d \d\d \d{3} \d{3}(?: \d\d)?|\d{2}/\d{3}/\d{5}"),
        re.compile(r"(?:19|20)\d{6}-\d{4}"),
        re.compile(r"\d{3}([ -])\d\d\1\d{4}"),
    ),
}


def _trim_number(text: str, begin: int, end: int) -> tuple[int, int]:
    while end > begin and not (text[end - 1].isalnum()):
        end -= 1
    if text[begin] == "(" and ")" not in text[begin:end]:
        begin += 1
    return begin, end


def _real_date(digits: str) -> bool:
    try:
        datetime.date(int(digits[:4]), int(digits[4:6]), int(digits[6:8]))
        return True
    except ValueError:
        return False


def _emails(text: str, line_of) -> Iterator[tuple]:
    i = text.find("@")
    while i >= 0:
        m = _DOMAIN.match(text, i + 1)
        if m:
            begin = i
            while begin and (text[begin - 1] in _LOCAL or (text[begin - 1] > "\x7f" and text[begin - 1].isalnum())):
                begin -= 1
            while begin < i and text[begin] in ".-+%":
                begin += 1
            if begin < i:
                yield from _email(text, begin, i, m.end(), m[0], line_of(i))
        i = text.find("@", i + 1)
    if any(w in text for w in (" dot ", " DOT ", "dot)", "dot]", "(at)", "[at]", "{at}", "(AT)", "[AT]")):
        for m in _SPELT.finditer(text):
            yield from _email(text, m.start(), m.end(1), m.end(), re.sub(r"[ (\[]*dot[ )\]]*", ".", m[2] or m[3], flags=re.I), line_of(m.start()))


def _email(text: str, begin: int, at: int, end: int, domain: str, line: _Line) -> Iterator[tuple]:
    before, after = line.before(begin), text[end : end + 1]
    last = domain.rpartition(".")[2]
    userinfo = text.rfind("://", max(line.begin, begin - 80), begin)
    inside = userinfo >= 0 and not re.search(r"[\s'\"<>]", text[userinfo:begin])
    votes = (
        1 if last.isalpha() and len(last) >= 2 else -1,
        -1 if inside or (before.endswith(":") and re.search(r"://\S*$", before)) else 0,
        -1 if after == ":" and re.match(r":[\w~./-]", text[end : end + 3]) else 1 if after in (">", "'", '"', ".", ",", ")", "]", "", "\n", "\r", " ", "<") else 0,
        -1 if begin > line.begin + 1 and text[begin - 1] not in "<'\"=: " and line.encoded(begin, end) else 0,
        -1 if _REMOTE.search(before) else 1 if _CUE["email"].search(before) else 0,
        -1 if domain.replace(".", "").isdigit() else 1 if len(domain) >= 6 else 0,
    )
    yield begin, end, "email", votes


def _numbers(text: str, line_of) -> Iterator[tuple]:
    for pattern, runs in ((_NUMBER, _NUMBER_RUN.finditer(text)), (_CODE, (None,))):
        for m in (m for r in runs if r is None or len(_DIGIT.findall(r[0])) > 4 for m in (pattern.finditer(text, r.start(), r.end()) if r else pattern.finditer(text))):
            begin, end = _trim_number(text, m.start(), m.end())
            span = text[begin:end]
            if len(span) < 8:
                continue
            digits = sum(c.isdigit() for c in span)
            if digits < 5 or digits > 16:
                continue
            kinds = [(kind, k) for kind in ("phone", "id_number") for k, shape in enumerate(_SHAPES[kind]) if shape.fullmatch(span)]
            if not kinds:
                continue
            line = line_of(begin)
            left, right = text[begin - 1 : begin], text[end : end + 1]
            before, after = line.before(begin), line.after(end)
            joined = (left.isalnum() or left in ("_", ".", "/", "-", "+", "@", "$", "%", "&", "*")) and begin > line.begin + 1 and left != ""
            joined = joined or (right.isalnum() or right in ("_", "@", "+", "=", "*") or (right in "-/." and text[end + 1 : end + 2].isalnum()) or (right == ":" and text[end + 1 : end + 2].isdigit()))
            against = -1 if _AGAINST_NUMBER.search(before) else 0
            tail = -1 if _AFTER_NUMBER.search(after) else 0
            cue = {k: bool(_CUE[k].search(before)) for k in ("phone", "id_number")}
            for kind, k in kinds:
                other = "id_number" if kind == "phone" else "phone"
                if kind == "phone":
                    strength = (1, 1, -1)[k] if not span.isdigit() else 0
                    own = 1 if cue["phone"] else -1 if cue[other] else 0
                    length = 1 if 9 <= digits <= 16 else -1
                else:
                    strength = (1, 1 if _real_date(span) else -1, 0)[k]
                    own = 1 if cue["id_number"] else -1 if cue[other] else 0
                    length = 1 if _AFTER_ID.search(after) else 0
                yield begin, end, kind, (strength, own, against, tail, -1 if joined else 1, length)


@functools.cache
def _road_automaton():
    if ahocorasick is None:
        return None
    automaton = ahocorasick.Automaton()
    for word in _ROAD_WORDS:
        automaton.add_word(word, len(word))
    automaton.make_automaton()
    return automaton


def _road_words(text: str) -> Iterator[int]:
    """Where words that an address needs begin, in order of their ends."""
    automaton = _road_automaton()
    if automaton is None:
        yield from sorted(m.start() for word in _ROAD_WORDS for m in re.finditer(re.escape(word), text))
    else:
        for end, size in automaton.iter(text):
            yield end - size + 1


def _addresses(text: str, line_of) -> Iterator[tuple]:
    lines: dict[int, _Line] = {}
    past = -1
    for i in _road_words(text):
        if i > past:
            line = line_of(i)
            lines[line.begin] = line
            past = line.end
    for line in lines.values():
        if not _HAS_NUMBER.search(text, line.begin, line.end):
            continue
        held: list[tuple[int, int]] = []
        for pattern in _ADDRESS:
            # what lies between the matches of the patterns before
            gaps = [*zip([line.begin, *(e for _, e in held)], [*(b for b, _ in held), line.end], strict=True)]
            for low, high in gaps:
                for m in pattern.finditer(text, low, high):
                    begin, end = m.start(), m.end()
                    unit = _ADDRESS_START.search(text, max(low, begin - 14), begin)
                    if unit and unit.end() == begin:
                        begin = unit.start()
                    before = line.before(begin)
                    left = text[begin - 1 : begin]
                    town = m["town"].split(" ")[0].lower()
                    votes = (
                        1 if m["num"] and m["street"] and town else -1,
                        1 if _CUE["address"].search(before) or left in ("'", '"', "=", ":") else 0,
                        1 if m["zip"] else 0,
                        1 if m["unit"] or text[begin].isalpha() else 0,
                        -1 if left.isalnum() or left in ("_", "/", "-") and begin > line.begin + 1 else 0,
                        -1 if town in _NOT_NAME and town not in _TOWN_OPENS else 1,
                    )
                    yield begin, end, "address", votes
                    held.append((begin, end))
            held.sort()


def _names(text: str, line_of, taken: list[tuple[int, int]]) -> Iterator[tuple]:
    starts = [t[0] for t in taken]
    at = 0
    while True:
        head = _NAME_HEAD.search(text, at)
        if head is None:
            return
        at = head.end()
        begin = head.start()
        left = text[begin - 1 : begin]
        if left.isalnum() or left in ("_", ".", "@", "/", "$", "%", "&", "~", "^", "\\", "|", "-", "+") and not (left in "+-" and text[begin - 2 : begin - 1] in ("\n", "")):
            continue
        tail = _NAME_TAIL.match(text, head.end())
        if tail is None:
            continue
        first = head[0]
        last = tail["given"] if tail["inv"] else tail["fam"]
        if len(first.rstrip(".")) < 2 and (not first.endswith(".") or tail["inv"]):
            continue
        if not tail["inv"] and len(last) < 3:
            continue
        low_first, low_last = first.lower().rstrip("."), last.lower().rstrip(".")
        if re.fullmatch(_TITLE + r"\.?", first):
            continue
        line = line_of(begin)
        end = tail.end()
        k = bisect.bisect_right(starts, begin) - 1
        inside = (k >= 0 and taken[k][1] > begin) or (k + 1 < len(taken) and taken[k + 1][0] < end)
        if inside:
            continue
        given = last if tail["inv"] else first
        folded = _fold(given).rstrip(".")
        before, after = line.before(begin), line.after(end, 90)
        shouted = first.isupper() and last.isupper() and len(first) > 2
        mixed = first.rstrip(".").isupper() != last.rstrip(".").isupper() and len(first.rstrip(".")) > 1 and len(last.rstrip(".")) > 1
        loud = bool(shouted and (line.loud or re.search(r"[A-ZÀ-Þ]{3,}[ ,.]+$", text[max(line.begin, begin - 16) : begin]) or re.match(r"[ ,.]+[A-ZÀ-Þ]{2,}\b", text[end : end + 8])))
        mail = re.match(r"\s*[<(]\s*([^@>\s]+)(?:@| at )", after)
        agrees = bool(mail and any(len(p) > 2 and p in _fold(mail[1]) for p in re.split(r"[ \-'’]", _fold(tail["fam"] or first))))
        more = re.match(rf" [{_U}][^\W\d_]+", text[end : end + 20]) if not tail["inv"] else None
        votes = (
            1 if agrees else -1 if mail else 0,
            1 if _CUE["name"].search(before) else 0,
            1 if folded in _GIVEN or (len(folded) == 1 and first.endswith(".")) or any(p in _GIVEN for p in folded.split("-")) else 0,
            -1 if (low_first in _NOT_NAME and not first.endswith(".")) or low_last in _NOT_NAME or loud or mixed else 0,
            -1 if re.search(r"(?:release|codename|version|branch|project|product|theme)\W{1,3}$", before) or re.match(r"[\"']? v?\d", after) else 1 if tail["mid"] or left in "'\"" and text[end : end + 1] in "'\"" else 0,
            -1 if more or line.encoded(begin, end) else 1 if text[end : end + 1] in ("", "\n", "\r", ".", ",", "'", '"', " ", "<", ")", ";") else 0,
        )
        yield begin, end, "name", votes
        if votes[3] >= 0:
            at = end


def candidates(text: str | None) -> list[tuple[int, int, str, tuple[int, ...]]]:
    """(begin, end, type, votes) of every span that may be personal information."""
    if not text:
        return []

    def line_of(at: int) -> _Line:
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        return _Line(text, text.rfind("\n", 0, at) + 1, end - 1 if end and text[end - 1] == "\r" and end > at + 1 else end)

    found = [*_emails(text, line_of), *_addresses(text, line_of)]
    taken = sorted((b, e) for b, e, _, _ in found)
    starts = [b for b, _ in taken]
    for c in _numbers(text, line_of):
        k = bisect.bisect_right(starts, c[0]) - 1
        if not (k >= 0 and taken[k][1] > c[0]):
            found.append(c)
    found += _names(text, line_of, taken)
    return found


# ---------------------------------------------------------------- aggregation


def _encode(votes: Iterable[int]) -> int:
    n = 0
    for v in votes:
        n = n * 3 + v + 1
    return n


def _decode(patterns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(patterns), LABELERS), dtype=np.int8)
    rest = patterns.copy()
    for j in range(LABELERS - 1, -1, -1):
        out[:, j] = rest % 3 - 1
        rest = rest // 3
    return out


#: Prior of a labeler's answers (against, none, for) on spans that are personal and on spans that are not: a Dirichlet
#: distribution that weighs as much as this share of the spans.
PRIOR = np.array([[0.02, 0.5, 0.48], [0.4, 0.5, 0.1]])
PRIOR_SHARE = 0.03


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation for a two-class model of conditionally independent labelers that may abstain.

    Returns the posterior of each vote pattern that a span is personal; how often each labeler votes -1, 0 and 1 on
    spans of either class, as [class, labeler, vote + 1] with the personal class first; and the share of that class.
    Nothing but the prior holds the estimates; a labeler that the votes of the others do not bear out loses its weight.
    """
    votes = _decode(patterns)
    weight = counts / counts.sum()
    answers = np.repeat(PRIOR[:, None, :], LABELERS, axis=1)
    hit = np.stack([votes == v for v in (-1, 0, 1)], axis=2)  # [pattern, labeler, vote]
    share = 0.5
    for _ in range(rounds):
        logit = np.log(share / (1 - share)) + (hit * np.log(answers[0] / answers[1])).sum((1, 2))
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        before, new = share, []
        for k, p in enumerate((weight * posterior, weight * (1 - posterior))):
            seen = np.einsum("p,plv->lv", p, hit) + PRIOR_SHARE * PRIOR[k]
            new.append(seen / seen.sum(1, keepdims=True))
        answers = np.stack(new)
        share = float(np.clip(((weight * posterior).sum() + 0.5 * PRIOR_SHARE) / (1 + PRIOR_SHARE), 0.01, 0.99))
        if abs(share - before) < 1e-9:
            break
    return posterior, answers, share


def _logit(w: np.ndarray, dense: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Bias, votes for and against (dense), and one weight from each of three tables of hashed context."""
    base = 1 + 2 * LABELERS
    z = w[0] + dense @ w[1:base]
    for k in range(3):
        z = z + w[base + k * BUCKETS + context[:, k]]
    return z


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _dense(votes: np.ndarray) -> np.ndarray:
    return np.concatenate([votes > 0, votes < 0], axis=1).astype(float)


def fit(votes: np.ndarray, context: np.ndarray, target: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights of a logistic span classifier under soft labels, by Adam; the context tables are never expanded."""
    dense, n, base = _dense(votes), len(votes), 1 + 2 * LABELERS
    w = np.zeros(base + 3 * BUCKETS)
    m, v, g = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w)
    decay = np.full_like(w, 2e-3)
    decay[base:] = 2e-2  # the context may only tip the scales
    for t in range(1, rounds + 1):
        error = _sigmoid(_logit(w, dense, context)) - target
        g[0], g[1:base] = error.sum(), error @ dense
        for k in range(3):
            g[base + k * BUCKETS : base + (k + 1) * BUCKETS] = np.bincount(context[:, k], error, BUCKETS)
        step = g / n + decay * w
        m, v = 0.9 * m + 0.1 * step, 0.999 * v + 0.001 * step * step
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _hash(text: str) -> int:
    h = 2166136261
    for c in text:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h % BUCKETS


def _context(text: str, begin: int, end: int) -> tuple[int, int, int]:
    before = re.search(r"([^\W\d_]+)\W*$", text[max(0, begin - 24) : begin])
    after = re.match(r"\W*([^\W\d_]+)", text[end : end + 24])
    shape = re.sub(r"[^\W\d_]+", "w", re.sub(r"\d", "9", text[begin : min(end, begin + 40)]))
    return _hash(before[1].lower() if before else "^"), _hash(after[1].lower() if after else "$"), _hash(shape)


_CANDIDATE = "doc_id bigint, begin int, finish int, pii_type string, pii_text string, pattern int, c0 int, c1 int, c2 int"


def candidate_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text in zip(batch["doc_id"], batch["text"], strict=True):
                if isinstance(text, str):
                    rows += [(i, b, e, t, text[b:e], _encode(v), *_context(text, b, e)) for b, e, t, v in candidates(text)]
            yield pd.DataFrame(rows, columns=["doc_id", "begin", "finish", "pii_type", "pii_text", "pattern", "c0", "c1", "c2"])

    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).mapInPandas(run, _CANDIDATE)


def _posteriors(counted: pd.DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, tuple]]:
    """By type: vote patterns, how often each occurs, and what reliabilities() makes of them."""
    out = {}
    for kind, own in counted.groupby("pii_type"):
        own = own.sort_values("pattern")
        patterns, counts = own["pattern"].to_numpy(dtype=np.int64), own["count"].to_numpy(dtype=float)
        out[str(kind)] = patterns, counts, reliabilities(patterns, counts)
    return out


def train(spans: DataFrame, train_rows: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """Classifier weights by type, from the vote patterns of all candidates and a bounded sample of them."""
    counted = spans.groupBy("pii_type", "pattern").count().toPandas()  # at most 5 * 3**LABELERS rows
    # the rows of least hash, cut down to little more than the sample before any of them leaves its task
    drawn = F.shiftright(F.xxhash64("doc_id", "begin", "pii_type"), 11)  # 53 bits
    share = min(1.0, 1.2 * (train_rows + 200) / max(1, int(counted["count"].sum())))
    rows_ = spans.select("pii_type", "pattern", "c0", "c1", "c2", drawn.alias("h")).where(F.col("h") < F.lit(int((2 * share - 1) * 2**52)))
    sample = rows_.orderBy("h", "pattern", "c0", "c1", "c2").limit(train_rows).toPandas()
    models = {}
    for kind, (patterns, _, (posterior, _, _)) in _posteriors(counted).items():
        rows = sample[sample["pii_type"] == kind]
        known = dict(zip(patterns.tolist(), posterior.tolist(), strict=True))
        # every pattern is seen at least once, whatever the sample holds
        votes = np.concatenate([_decode(rows["pattern"].to_numpy(dtype=np.int64)), _decode(patterns)])
        context = np.concatenate([rows[["c0", "c1", "c2"]].to_numpy(dtype=np.int64).reshape(-1, 3), np.zeros((len(patterns), 3), dtype=np.int64)])
        target = np.array([known[p] for p in rows["pattern"]] + posterior.tolist())
        models[kind] = fit(votes, context, target)
    return models


def score(models: dict[str, np.ndarray], kinds: np.ndarray, patterns: np.ndarray, context: np.ndarray) -> np.ndarray:
    out = np.zeros(len(kinds))
    votes = _decode(patterns.astype(np.int64))
    for kind, w in models.items():
        k = np.flatnonzero(kinds == kind)
        if len(k):
            out[k] = _sigmoid(_logit(w, _dense(votes[k]), context[k]))
    return out


def _accepted(spans: DataFrame, models: dict[str, np.ndarray], threshold: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = score(models, batch["pii_type"].to_numpy(), batch["pattern"].to_numpy(), batch[["c0", "c1", "c2"]].to_numpy(dtype=np.int64).reshape(-1, 3))
            yield batch[["doc_id", "begin", "finish", "pii_type", "pii_text"]].assign(score=p)[p >= threshold]

    return spans.mapInPandas(run, "doc_id bigint, begin int, finish int, pii_type string, pii_text string, score double")


def find_personal(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, pii_type, pii_text: one row per document and distinct text that the span classifier accepts.

    A text accepted as two kinds of number in one document keeps the likelier one.
    """
    spans = candidate_spans(df, id_col, text_col).checkpoint()
    accepted = _accepted(spans, train(spans, train_rows), threshold)
    best = accepted.groupBy("doc_id", "pii_text").agg(F.max(F.struct("score", "pii_type")).alias("best"))
    return best.select("doc_id", F.col("best.pii_type").alias("pii_type"), "pii_text")


_SPANS = ("begins", "ends", "kinds", "patterns", "c0", "c1", "c2")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, redacted text, number of spans replaced: each accepted span becomes ``[TYPE]``, all else is unchanged.

    The candidates are looked for once and written beside their texts, the classifier is fitted on them, and a second
    map over what was written replaces the accepted ones; no text is shuffled.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = [[(b, e, TYPES.index(t), _encode(v), *_context(text, b, e)) for b, e, t, v in candidates(text)] if isinstance(text, str) else [] for text in batch["text"]]
            yield batch.assign(**{name: [[s[k] for s in own] for own in spans] for k, name in enumerate(_SPANS)})

    def replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_replaced(models, t, own, threshold) for t, *own in zip(batch["text"], *(batch[c] for c in _SPANS), strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "redacted": [r[0] for r in rows], "n_spans": [r[1] for r in rows]})

    # the id travels as text, since pandas would turn whole numbers beside a null into floats
    texts = df.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    found = written(texts.mapInPandas(find, "doc_id string, text string, " + ", ".join(f"{c} array<int>" for c in _SPANS)), "spans")
    named = F.element_at(F.array(*map(F.lit, TYPES)), F.col("s.kinds") + 1)
    spans = found.select(F.xxhash64("doc_id").alias("doc_id"), F.explode(F.arrays_zip(*_SPANS)).alias("s")).select(
        "doc_id", F.col("s.begins").alias("begin"), named.alias("pii_type"), F.col("s.patterns").alias("pattern"), *[F.col(f"s.{c}").alias(c) for c in ("c0", "c1", "c2")]
    )
    models = train(spans, train_rows)
    rows = found.mapInPandas(replace, "doc_id string, redacted string, n_spans int")
    return rows.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def _replaced(models: dict[str, np.ndarray], text: str | None, spans: list, threshold: float) -> tuple[str | None, int]:
    """text with its accepted spans replaced, and how many."""
    begins, ends, kinds, patterns, *context = map(np.asarray, spans)
    if not isinstance(text, str) or not len(begins):
        return (text if isinstance(text, str) else None), 0
    names = np.array(TYPES, dtype=object)[kinds]
    p = score(models, names, patterns, np.stack(context, axis=1).astype(np.int64))
    chosen = sorted((-s, int(b), int(e), k) for s, b, e, k in zip(p, begins, ends, names, strict=True) if s >= threshold)
    free: list[tuple[int, int, str]] = []
    for _, b, e, kind in chosen:  # likelier spans first; a later one that overlaps is part of it
        k = bisect.bisect_left(free, (b,))
        if (k == 0 or free[k - 1][1] <= b) and (k == len(free) or free[k][0] >= e):
            free.insert(k, (b, e, kind))
    out, at = [], 0
    for b, e, kind in free:
        out += [text[at:b], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]]), len(free)


def labelers(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(pii_type, labeler, vote, share_personal, share_other): how often a labeler votes so on personal spans and on others, as estimated over all texts.

    One row per type, labeler and vote of -1, 0 and 1; no candidates of a type, no rows of it.
    """
    counted = candidate_spans(df, id_col, text_col).groupBy("pii_type", "pattern").count().toPandas()  # at most 5 * 3**LABELERS rows
    rows = [
        (kind, j + 1, v - 1, float(answers[0, j, v]), float(answers[1, j, v]))
        for kind, (_, _, (_, answers, _)) in _posteriors(counted).items()
        for j in range(LABELERS)
        for v in range(3)
    ]
    return df.sparkSession.createDataFrame(rows, "pii_type string, labeler int, vote int, share_personal double, share_other double")
