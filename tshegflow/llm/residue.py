"""Template leftovers, filler and site notices that stand in the place of content.

Each kind of placeholder has a grammar of its own, by its delimiters. What is only quoted or explained - in code, in quotation marks, in a sentence about
templates - is discounted by its surroundings, and what stands in a text about templates, sites or programs by how much of the text it makes up. Filler is
known by how it opens a sentence, a notice by what it is made of (``notices``).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import notices
from .triggers import needed_words
from .unicode_forms import normalize_text

# Names of fields that templates fill in.
FIELD_WORDS = (
    "title titel titre 标题 題名 མཚན་བྱང verfasser author auteur autor 作者 translator date datum 日期 summary abstract body text content colophon name page "
    "ཡིག་ཆའི་ནང་དོན description subtitle heading category url link email address company company_name username user first_name last_name placeholder"
).split()
# What editors put in brackets, and mark-up.
EDITORIAL = "illegible sic damaged lacuna gap unclear missing blank cut margin note notes deleted added crossed torn lost b i u em br p hr div span strong code pre sup sub ul ol li a img table tr td th h1 h2 h3 h4".split()
# Words of sentences about templates, and of texts that teach programming.
EXPLAINING = (
    r"\b(?:explains? (?:that|how)|stands? for|means|denotes?|represents?|(?:is|are|gets?) replaced (?:by|with)|expands? to|evaluates? to|prints?|is called|looks? like|written as|such as|for example|for instance|e\.g\.|i\.e\.|the (?:phrase|word|form|notation)|as in|puts? in)\b"
    r"|steht für|bedeutet|zum beispiel|z\. ?b\.|wird (?:durch|ersetzt)|ersetzt|signifie|par exemple|remplacée?s? par|désigne|表示|代表|例如|比如|替换|означает|например|заменяется"
)
TOPIC = (
    r"\b(?:templates?|templating|placeholders?|variables?|syntax|mustache|handlebars|jinja2?|liquid|twig|smarty|django|rails|erb|php|html5?|css|javascript|typescript|python|java|sql|json|yaml|xml|api|sdk|bash|shell|regex|code|coding|snippets?|tutorials?|developers?|programm\w+|functions?|methods?|arguments?|parameters?|strings?|delimiters?|braces|brackets"
    r"|escap(?:e|ed|es|ing)|render(?:s|ed|er|ing)?|interpolat\w+|substitut\w+|slots?|tokens?|expressions?|engine|browsers?|servers?|clients?|requests?|responses?|status codes?|http|endpoints?|exceptions?|debug\w*|frameworks?|components?|config\w*|settings?|command|terminal|compil\w+|loops?|merge fields?|dummy|filler|typesett\w+"
    r"|platzhalter\w*|variablen?|beispiel\w*|programmier\w*|funktion(?:en)?|entwickler\w*|statuscodes?|gabarits?|espaces? réservés?|développeurs?|fonctions?|exemples?|programmation)\b|模板|占位符|变量|语法|代码|示例|教程|函数|参数|开发|浏览器|状态码|шаблон\w*|переменн\w*|пример\w*|код\b"
)
# Words of dummy Latin.
DUMMY_LATIN = set(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat "
    "cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
# Tokens that are typed to fill space.
DUMMY_TOKENS = "asdf qwer qwerty blah bla xxxx xxx ____ ___ test placeholder foo bar dummy tbd".split()
_PARTS = "text|content|title|name|description|paragraph|heading|headline|caption|copy|body|quote|bio|tagline|subtitle|introduction|section|message"
_DUMMY = "sample|dummy|placeholder|filler|example|default|demo|test|nonsense"
# How filler opens a sentence, by language: what goes here, what to replace, what this part is.
FILLER = (
    rf"(?:your |the |some |more )?(?:{_PARTS})s? (?:goes|go|comes|will go|will come|to go|to be (?:added|written|inserted)|will be (?:added|written|inserted)|will appear) (?:here|in here|later|soon)",
    rf"(?:to ?do:? ?|tbd:? ?|fixme:? ?)?(?:please )?(?:replace|insert|add|enter|type|write|put|place|paste|edit|change) (?:this|your|the|some|a|an|more|it)? ?(?:own )?(?:(?:{_DUMMY}) )?(?:{_PARTS})s?(?: (?:here|below|later|soon|with (?:your|the|real|actual) .{{1,40}}|in this (?:box|section|space|field)))?\s*$",
    rf"click (?:here )?to (?:add|edit|insert|enter) (?:an? |the |your )?(?:{_PARTS}|image|picture|photo)", rf"(?:{_DUMMY}) (?:text|words?|content|copy|paragraph|title|heading|post|page)s?(?:\s*$| (?:for|only|here|to be|goes|until|that will)\b)",
    rf"(?:this|the following) (?:{_PARTS}|page|block|area|chapter|field|space|article|post|entry|column)s? (?:is|are|was|has been|will be|contains) (?:intentionally |deliberately |currently |still |only |just )?(?:(?:left |filled )?(?:blank|empty)|(?:filled |filled up )?(?:with |by )?(?:a |an |some )?(?:{_DUMMY})\b|under construction|to be (?:written|added|completed|determined|done)|not yet (?:written|available|ready))",
    rf"this is (?:a |an |some |just |only |your )*(?:{_DUMMY}) (?:{_PARTS}|page|post|sentence|document|article)", r"just another \w+ site", r"hier (?:steht|folgt|kommt|erscheint|entsteht|könnte)\b.{0,24}\b(?:text|inhalt|titel|überschrift|beitrag)",
    r"(?:das ist |dies ist |ein |nur )*(?:blind|platzhalter|muster|beispiel|füll)text", r"(?:bitte )?(?:ihren |den |einen )?(?:text|inhalt|titel)(?: hier)? (?:eingeben|einfügen|ergänzen|ersetzen)", r"(?:ici )?(?:le|votre|du|mon) (?:texte|contenu|titre) (?:viendra|sera|apparaîtra|va|est à)\b",
    r"texte (?:à venir|ici|de remplissage|factice|d['’]exemple|provisoire)", r"faux[- ]texte", r"(?:insére[rz]|saisir|saisissez|ajoute[rz]|remplace[rz]|écrire|écrivez) (?:le|votre|du|ce|un) (?:texte|contenu|titre|paragraphe)", r"(?:请)?在?(?:此处|这里|此)[^。！？]{0,2}(?:填写|输入|放置|添加|插入|编写|写入)",
    r"(?:这是|此为)?(?:示例|占位|样本|测试|填充|默认)(?:文字|文本|文本|内容|标题|段落)", r"(?:正文|内容|文字|标题)?待(?:补充|填写|完善)", r"[^\s།]*འདིར་[^\s།]*(?:འབྲི|བྲིས|འཇུག|བླུག|བཞག|སྣོན|འགོད)[^\s།]*(?:རྒྱུ|རོགས|དགོས|གནང)", r"энд .{0,24}(?:бичнэ|бичих|бичээрэй|оруул)", r"(?:अत्र|यहाँ|यहां) .{0,24}(?:लिख|पाठ|सामग्री)",
    r"здесь (?:будет|должен быть|появится) .{0,16}текст", r"вставьте (?:сюда )?(?:ваш )?текст", r"aquí va (?:el|su|tu) (?:texto|contenido|título)", r"texto de (?:ejemplo|relleno|prueba)",
)
# Filler that counts only as a whole sentence or line.
WHOLE_FILLER = (
    r"coming soon", r"untitled(?: document| page| post)?", r"no (?:description|content|title|text|abstract|summary)(?: available| provided| yet)?", r"(?:page |site )?under construction", r"lorem ipsum", r"tbd", r"tba", r"to be (?:announced|determined|written|completed)", rf"(?:{_PARTS}) here", r"hello world",
    r"content (?:coming|pending)(?: soon)?", r"demnächst(?: hier| verfügbar)?", r"ohne titel", r"inhalt folgt", r"bientôt disponible", r"sans titre", r"à compléter", r"敬请期待", r"无标题", r"未命名", r"建设中", r"即将推出", r"暂无(?:描述|内容|标题|简介|数据)", r"скоро здесь", r"без названия", r"próximamente", r"sin título",
)

_NAME = r"[^\W\d][\w.\-ༀ-࿿]*(?: [\w.\-ༀ-࿿]+){0,3}"
_STRONG = re.compile(
    rf"\{{\{{\{{?\s*{_NAME}\s*\}}?\}}\}}|\$\{{\s*{_NAME}\s*\}}|#\{{\s*{_NAME}\s*\}}|\{{%-?\s*{_NAME}\s*-?%\}}|<%[=\-]?\s*{_NAME}\s*-?%>|\[\[\s*{_NAME}\s*\]\]|@@\s*{_NAME}\s*@@|%\({_NAME}\)[sdf]"
    rf"|\[(?:INSERT|insert|ADD|YOUR|your) {_NAME}\]|\[{_NAME} (?:goes )?here\]|\((?:your |insert |INSERT ){_NAME}(?: here)?\)|\((?:{_NAME}) goes here\)|(?<![A-Za-z0-9_])__[^\W_]{_NAME[len(r"[^\W\d]"):]}__(?![A-Za-z0-9_])|(?<![\w$])\${_NAME}\$|%%{_NAME}%%"
)
_WEAK = re.compile(rf"\[\s*({_NAME})\s*\]|\{{\s*({_NAME})\s*\}}|<\s*({_NAME})\s*>|(?<![\w:]):({_NAME}):(?![\w:])|«\s*({_NAME})\s*»|(?<![\w%])%({_NAME})%(?![\w%])|(?<![\w#])#({_NAME})#(?![\w#])")
_CODE = re.compile(r"```.*?```|~~~.*?~~~|`[^`\n]*`|<(pre|code)\b.*?</\1>", re.S)
_FOLD = {ord("༌"): "་", 0xA0: " ", 0x3000: " ", 0x2005: " ", 0x202F: " ", 0xAD: None, 0x34F: None, 0x200B: None, 0x200C: None, 0x200D: None, 0x2060: None, 0xFEFF: None}
_HIDDEN = re.compile("[" + "".join(map(chr, _FOLD)) + "]")
_ODD = re.compile(r"[Ͱ-ӿＡ-Ｚａ-ｚﬀ-ﬆ̀-ͯ]")
_DELIMITED = re.compile(r"[{$<\[@%«#]|__|(?<!\w):\w|\((?:your|insert|INSERT)\b|goes here\)")


@lru_cache(1)
def _phrases() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    filler = re.compile("|".join(f"(?:{normalize_text(p)})" for p in FILLER))
    whole = re.compile("(?:" + "|".join(WHOLE_FILLER) + r")\s*")
    tokens = "|".join(map(re.escape, DUMMY_TOKENS))
    typed = re.compile(rf"(?<![\w])(?P<hit>(?:{tokens})(?:[ .,]+(?:{tokens})){{2,}})(?!\w)")
    return filler, whole, typed


_FILLER, _WHOLE, _TYPED, _LATIN, _NOTICE = (1 << k for k in range(5))


def trigger_words() -> dict[str, int]:
    """Words without which no pattern of a kind can match, with the kinds as bits. They are taken from the patterns, so that none is forgotten."""
    out: dict[str, int] = {}
    for kind, patterns in ((_FILLER, map(normalize_text, FILLER)), (_WHOLE, WHOLE_FILLER), (_NOTICE, map(normalize_text, notices.patterns()))):
        for pattern in patterns:
            for w in needed_words(pattern):
                out[w] = out.get(w, 0) | kind
    for w in (token + mark for token in DUMMY_TOKENS for mark in " .,"):
        out[w] = out.get(w, 0) | _TYPED
    for w in DUMMY_LATIN:
        if len(w) > 4:  # the short ones are words of other Latin and of other languages
            out[w] = out.get(w, 0) | _LATIN
    return out


@lru_cache(1)
def _triggers():
    """An automaton of the trigger words."""
    import ahocorasick

    found = ahocorasick.Automaton()
    words = trigger_words()
    for w in words:
        found.add_word(w, words[w])
    found.make_automaton()
    return found


_TOPIC, _EXPLAINING = re.compile(TOPIC), re.compile(EXPLAINING)
#: A text of which this share of the other sentences is about templates, sites and programs is about them, unless this share of its sentences is residue.
TOPIC_SHARE, RESIDUE_SHARE = 0.25, 0.5


def _teaches(low: str, hits: set[tuple[int, int]], units: list[tuple[int, int]]) -> bool:
    """Whether the text is about such things: by the share of its other sentences that are, and by how much of the text the residue makes up."""
    others = [u for u in units if u not in hits]
    if len(others) < 2 or len(hits) >= RESIDUE_SHARE * len(units):
        return False
    about = sum(bool(_TOPIC.search(low, *u)) for u in others)
    return about >= max(2, TOPIC_SHARE * len(others))


def _code_spans(text: str) -> list[tuple[int, int]]:
    """Fenced and inline code, marked-up code, and indented lines in a text that has lines that are not."""
    spans = [m.span() for m in _CODE.finditer(text)] if "`" in text or "<" in text else []
    if "\n    " in text or "\n\t" in text or text.startswith(("    ", "\t")):
        lines = [m.span() for m in re.finditer(r"(?m)^(?: {4}|\t).*$", text)]
        if re.search(r"(?m)^\S", text):
            spans += lines
    return spans


def _placeholders(text: str) -> list[tuple[int, int]]:
    """Places of unfilled placeholders, without those in code."""
    if not _DELIMITED.search(text):
        return []
    found = [m.span() for m in _STRONG.finditer(text)]
    for m in _WEAK.finditer(text):
        name = next(g for g in m.groups() if g).strip()
        low = name.lower()
        if low in EDITORIAL:
            continue
        label = text[max(0, m.start() - len(name) - 3) : m.start()].strip(" :：\n").lower()
        if low in FIELD_WORDS or re.search(r"\w[_.]\w", name) and not re.search(r"\d|\s", name) or re.fullmatch(r"[A-Z]{3,}(?:_[A-Z]+)*", name) or label == low:
            found.append(m.span())
    if not found:
        return []
    code = _code_spans(text)
    return [(a, b) for a, b in found if not any(x <= a and b <= y for x, y in code)]


def _unfilled(text: str, found: list[tuple[int, int]]) -> bool:
    """Whether one of the placeholders is left over: its sentence does not explain it, and the text is not about templates."""
    blank = list(text)
    for a, b in found:
        blank[a:b] = "x" * (b - a)
    low = "".join(blank).lower()
    units = notices.units(low)
    starts = [a for a, _ in units]
    hits: set[tuple[int, int]] = set()
    for a, _ in found:
        unit = units[max(0, bisect_right(starts, a) - 1)] if units else (0, len(low))
        if not _EXPLAINING.search(low, *unit) and not _TOPIC.search(low, *unit):
            hits.add(unit)
    return bool(hits) and not _teaches(low, hits, units)


def _dummy_latin(text: str) -> bool:
    """Ten neighbouring words of which at least eight are dummy Latin."""
    words = re.findall(r"[a-z]+", text)
    flags = [w in DUMMY_LATIN for w in words]
    score = sum(flags[:10])
    if len(flags) >= 4 and score >= max(4, 0.8 * min(10, len(flags))):
        return True
    for i in range(10, len(flags)):
        score += flags[i] - flags[i - 10]
        if score >= 8:
            return True
    return False


def residue_kinds(text: str | None) -> list[str]:
    """The kinds of residue in ``text``, in order: placeholder, filler, notice. Null and empty texts have none."""
    if not text:
        return []
    kinds = []
    if _ODD.search(text):
        text = normalize_text(text)
    if _HIDDEN.search(text):
        text = text.translate(_FOLD)
    if (found := _placeholders(text)) and _unfilled(text, found):
        kinds.append("placeholder")
    low = re.sub(r"[^\S\n]+", " ", text).lower().replace("’", "'")
    maybe, at = 0, []
    for end, kind in _triggers().iter(low):
        maybe |= kind
        at.append(end)
    if not maybe:
        return kinds
    filler, whole, typed = _phrases()
    plain = notices.unquoted(low)
    every = notices.units(plain)
    ends = [b for _, b in every]
    units = [every[k] for k in sorted({bisect_right(ends, e) for e in at}) if k < len(every)]
    filled, told = set(), set()
    for a, b in units:
        unit = notices.lead(plain[a:b])
        if maybe & _FILLER and filler.match(unit) or maybe & _WHOLE and whole.fullmatch(unit):
            filled.add((a, b))
        if maybe & _NOTICE and notices.is_notice(unit):
            told.add((a, b))
    if maybe & _TYPED and typed.search(low) or maybe & _LATIN and _dummy_latin(low) or filled and not _teaches(plain, filled, every):
        kinds.append("filler")
    if told and not _teaches(plain, told, every):
        kinds.append("notice")
    return kinds


@F.pandas_udf(T.ArrayType(T.StringType()))
def _kinds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in batches:
        yield pd.Series([residue_kinds(t) for t in series])


def residues(documents: DataFrame) -> DataFrame:
    """``(doc_id, kinds)`` for every document with template leftovers, filler or a site's notice in the place of content; ``kinds`` is sorted by kind.

    Documents that only talk about such things do not come out. Null and empty texts have no residue; repeated rows give their rows again.
    """
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), _kinds.asNondeterministic()("text").alias("kinds")).where(F.size("kinds") > 0)


def without_residue(documents: DataFrame) -> DataFrame:
    """``documents`` without those that ``residues`` finds; all columns are kept as they are."""
    bad = F.size(_kinds.asNondeterministic()(F.col("text"))) > 0
    return documents.where(~bad)
