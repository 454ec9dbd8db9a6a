"""Sentences that a site says in the place of content: failures, closed doors, missing scripts, requests to try again.

A sentence is judged by what it is made of and not by its wording: a thing of the web, what failed, what a script is needed for, what the visitor should do, a
status code. Each language has words for these parts. What is quoted, told of the past or of oneself is a mention and no notice, unless the visitor is spoken to.
"""

from __future__ import annotations

import re
from functools import lru_cache

# Status codes and their reason phrases, as the standard of the protocol names them.
STATUS = "400 401 402 403 404 405 406 407 408 409 410 411 412 413 414 415 416 417 418 421 422 423 424 425 426 428 429 431 451 500 501 502 503 504 505 506 507 508 510 511 520 521 522 523 524 525".split()
REASONS = (
    "bad request|unauthori[sz]ed|payment required|forbidden|not found|method not allowed|not acceptable|proxy authentication required|request time-?out|conflict|gone|length required|precondition failed"
    "|payload too large|uri too long|unsupported media type|too many requests|internal (?:server )?error|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable"
    "|gateway time-?out|network authentication required|unavailable for legal reasons"
)
# Words of each part, by language. A part that a language says by word order has patterns.
SCRIPT = {
    "en": r"java ?script|js|scripts?|scripting|cookies?", "de": r"java ?script|skripte?|scripte?|cookies?", "fr": r"java ?script|scripts?|cookies?|témoins", "es": r"java ?script|cookies", "zh": r"java ?script|脚本|cookie",
    "bo": r"java ?script|cookie", "mn": r"java ?script|скрипт\w*|күүки\w*", "hi": r"java ?script|जावास्क्रिप्ट|कुकीज़?", "ru": r"java ?script|скрипт\w*|куки",
}
#: The script must be switched on. ``{s}`` stands for the script words.
NEEDS = {
    "en": r"(?:^|\b(?:please|must|to|should|you|and|then|need to|have to)\s)(?:re-?)?(?:enable|activate|allow|turn on|switch on|accept)\s(?:[\w-]+\s){{0,3}}?(?:{s})\b|\b(?:needs?|requires?|depends? on|relies on|works? (?:only|best) with|(?:not|n't) work (?:properly )?without|empty without|limited without)\s(?:[\w-]+\s){{0,3}}?(?:{s})\b"
    r"|(?:{s})(?:\s(?:and|or)\s(?:{s}))?(?:\ssupport)?\s(?:is|are|must|should|has|have|seems?|appears?|needs?)\s(?:[\w-]+\s){{0,3}}?(?:disabled|blocked|required|needed|off|enabled|allowed|turned on|switched on|active|accepted|mandatory|necessary)\b|(?:{s}) (?:disabled|blocked|required|is off)\b|\bturn (?:{s}) on\b|\bnoscript\b",
    "de": r"(?:{s})\b.*\b(?:aktivieren|einschalten|zulassen|aktiviert|deaktiviert|ausgeschaltet|abgeschaltet|blockiert|erforderlich|benötigt|notwendig|erlauben|akzeptieren)\b|\b(?:aktivieren|schalten|benötigt|erfordert|braucht|erlauben|akzeptieren|ohne)\b.*(?:{s})\b",
    "fr": r"\b(?:activer|activez|autoriser|autorisez|accepter|acceptez|nécessite|nécessitent|requiert|sans|besoin)\b.*(?:{s})\b|(?:{s})\b.*\b(?:désactivée?s?|bloquée?s?|requis|requise?s?|nécessaires?|activée?s?|autorisée?s?|obligatoires?)\b",
    "es": r"\b(?:active|habilite|activa|habilita|activar|habilitar|requiere|necesita|acepte)\b.*(?:{s})\b|(?:{s})\b.*\b(?:desactivad[oa]s?|deshabilitad[oa]s?|necesari[oa]s?|habilitad[oa]s?)\b",
    "zh": r"(?:启用|开启|打开|允许|需要|激活|接受).{{0,8}}(?:{s})|(?:{s}).{{0,8}}(?:禁用|已关闭|未启用|未开启|被阻止|支持|启用|开启)",
    "bo": r"(?:{s})[\s་ལཏ]*(?:སྒོ་འབྱེད|ཁ་ཕྱེ|སྤར|སྤྱོད|དགོས)", "mn": r"(?:{s})\b.*(?:асаа|идэвхжүүл|зөвшөөр|унтраа|шаардлагатай|хаалттай)|(?:асаа|идэвхжүүл)\w*\b.*(?:{s})", "hi": r"(?:{s}).*(?:चालू|सक्षम|सक्रिय|आवश्यक|बंद|अनुमति)",
    "ru": r"\b(?:включите|разрешите|активируйте|требуется|необходим\w*|требует)\b.*(?:{s})|(?:{s})\b.*\b(?:отключ\w+|выключ\w+|необходим\w*|заблокирован\w*|включ\w+)",
}
#: A failure that only sites have.
FAILS = {
    "en": rf"not found on this (?:server|site|website)|(?:page|file|url|site|document|record|item|entry|article|resource|text|content|host|address|link) (?:(?:can ?not|could not|couldn't|can't) be found|(?:was |is )?not found|does(?: not|n't) exist|(?:is not|isn't) available|no longer exists|is no longer available|has (?:been )?(?:moved|removed|deleted))|(?:internal|server|application|network|gateway|runtime|database|fatal|proxy|connection) error|{REASONS.replace('|forbidden|not found', '').replace('|conflict|gone', '').replace('|not acceptable', '').replace('|payment required', '').replace('|not implemented', '').replace('|length required', '').replace('unauthori[sz]ed|', '')}"
    r"|something (?:has gone|went|is) wrong|(?:exception|error) (?:has )?occurred|an? (?:unexpected|unknown|internal) (?:error|exception|condition)|error code|session (?:has |is )?(?:been )?(?:expired|ended|timed out|closed)|(?:has |have )?timed out|time ?out while|(?:service|server|system|site|upstream|gateway|host|backend)\b.* (?:did not|does not|is not|failed to|refused to) (?:answer|respond|connect|answering|responding)|(?:server|service|system|site) is (?:busy|down|overloaded|offline|unavailable|under maintenance)"
    r"|(?:temporarily|currently) (?:unavailable|offline|out of service)|down for maintenance|browser is (?:too old|not supported|no longer supported|out of date|outdated|unsupported)|(?:do not|don't) have (?:the )?(?:permission|rights?|access)|(?:not|aren't) (?:authori[sz]ed|allowed|permitted) to (?:view|access|open|see)|checking your (?:browser|connection)|verify(?:ing)? (?:that )?you are (?:a )?human|unusual traffic|security check|rate limit|(?:could not|couldn't|cannot|can't|unable to|failed to) (?:be )?(?:load|loaded|connect|render|rendered|retrieve)\b|(?:could not|cannot|can't) be (?:\w+) (?:at the moment|right now|at this time|currently)"
    rf"|^(?:the|this|that) [\w-]+ (?:that )?you(?:'re| are| were| have|'ve)? (?:asked|request|look|tri|search|want|access|select)\w*\b.*\b(?:not|no longer|gone|moved|removed|unavailable|missing|deleted)\b|\b(?:is|are|has been) (?:gone|missing|removed|moved|deleted) \((?:http |error )?(?:{'|'.join(STATUS)})\)",
    "de": r"(?:seite|datei|dokument|eintrag|adresse|inhalt|datensatz|artikel|text)\b.*\b(?:nicht gefunden|nicht vorhanden|existiert nicht|nicht (?:mehr )?verfügbar|nicht (?:geladen|angezeigt|geöffnet) werden)|(?:server|datenbank|anwendungs|verbindungs|netzwerk|system)-?fehler\w*|interner fehler|fehlercode|zugriff (?:wurde )?verweigert|sitzung (?:ist )?abgelaufen|(?:dienst|server|system)\b.*(?:nicht verfügbar|nicht erreichbar|überlastet|ausgefallen)|ein fehler ist aufgetreten|etwas ist schief|zeitüberschreitung|keine berechtigung|(?:browser)\b.*(?:nicht unterstützt|veraltet)|zu viele anfragen|wartungsarbeiten",
    "fr": r"(?:page|fichier|document|entrée|adresse|ressource|article|contenu|texte)\b.*\b(?:introuvable|non trouvée?|n[’']existe (?:pas|plus)|plus disponible|indisponible|pas pu être)|erreur (?:interne|serveur|du serveur|réseau|de connexion|inconnue|fatale|\d{3})|code d[’']erreur|accès (?:refusé|interdit)|session\b.*expiré|(?:service|serveur|site)\b.*(?:indisponible|surchargé|ne répond pas|en maintenance)|une erreur (?:est survenue|s[’']est produite)|délai (?:d[’']attente )?dépassé|navigateur\b.*(?:obsolète|pas pris en charge|trop ancien)|trop de requêtes|pas (?:l[’']autorisation|le droit)",
    "es": r"(?:página|archivo|documento|recurso)\b.*\b(?:no encontrad[oa]|no existe|no (?:se )?(?:pudo|puede))|error (?:interno|del servidor|de conexión)|acceso (?:denegado|prohibido)|sesión\b.*(?:caducad|expirad)|servicio no disponible|código de error|algo salió mal|demasiadas solicitudes",
    "zh": r"(?:页面|网页|网站|链接|文件|内容|资源|地址|条目|记录|文档).{0,6}(?:不存在|未找到|找不到|已删除|已失效|已过期|无法(?:访问|打开|显示|加载))|(?:找不到|未找到|无法(?:访问|打开|显示|加载)).{0,6}(?:页面|网页|网站|文件|内容|资源|条目|记录|文档)|(?:服务器|系统|网络|程序|数据库|连接|应用)(?:内部|发生|出现|出)?.{0,2}(?:错误|异常|繁忙|超时|故障|维护|失败|无响应)|错误(?:代码|码|编号)|(?:访问|请求|操作).{0,3}(?:被拒绝|被禁止|受限|过于频繁|太频繁|超时)|拒绝访问|禁止访问|(?:没有|无)(?:访问|查看)?权限|会话.{0,3}(?:过期|失效|结束)|登录.{0,3}(?:过期|失效|超时)|服务.{0,3}(?:不可用|暂停)|浏览器.{0,6}(?:过低|过旧|不支持)|(?:加载|请求)失败",
    "bo": r"(?:ཤོག་ངོས|དྲ་ངོས|དྲ་ཚིགས|དྲ་བ|ཡིག་ཆ|ཡིག་སྣོད)[^\s]*(?:རྙེད་མ་|མ་རྙེད|མི་འདུག|ནོར་འཁྲུལ|མ་ཐུབ|མི་ཐུབ)|(?:ཞབས་ཞུ|དྲ་བ|འཕྲུལ)[^\s]*(?:འབྲེལ་)?[^\s]*(?:མ་ཐུབ|མི་ཐུབ|ནོར་འཁྲུལ)|ནོར་(?:ཨང|འཁྲུལ་ཨང)|དབང་(?:ཚད|ཆ)་མེད",
    "mn": r"(?:хуудас|файл|бичлэг|хаяг|баримт|мэдээлэл)\b.*(?:олдсонгүй|байхгүй|нээгдсэнгүй)|(?:сервер|систем|холболт|сүлжээ)\w*\b.*(?:алдаа|ачаалал|салсан|хариу)|алдааны? код|хандах эрх\w*|(?:хугацаа|сесс\w*)\b.*дуус|үйлчилгээ\b.*боломжгүй",
    "hi": r"(?:पृष्ठ|पेज|फ़ाइल|सामग्री|लेख)\S*\s.*(?:न\s?लब्ध|न\s?प्राप्त|नहीं मिल|नास्ति|उपलब्ध नहीं|न विद्यते)|(?:सर्वर|नेटवर्क|आन्तरिक|आंतरिक|तन्त्र)\S*\s.*(?:त्रुटि|दोष|व्यस्त)|त्रुटि(?:\s|-)?(?:कोड|सङ्केत|क्रम)|(?:अनुमति|अधिकार)\S*\s.*(?:नहीं|नास्ति|न )|सत्र\S*\s.*समाप्त|प्रवेश\S*\s.*(?:निषिद्ध|निषेध|अस्वीकृत)",
    "ru": r"(?:страница|файл|документ|ресурс)\b.*(?:не найден|не существует|недоступ)|ошибка (?:сервера|сети|соединения|приложения)|код ошибки|доступ (?:запрещ|закрыт|огранич)|сессия\b.*(?:истек|заверш)|(?:сервис|сервер|сайт)\b.*(?:недоступ|перегруж|не отвеча)|что-то пошло не так|слишком много запросов",
}
#: What the visitor should do.
ACTS = {
    "en": r"(?:please |then |and )?(?:try again|retry)(?: (?:later|soon|shortly|in an?|in \w+ (?:minutes?|seconds?|moments?|hours?)|tomorrow|now)\b|\s*$)|(?:please )?(?:reload|refresh) (?:the|this|your) (?:page|browser|window|site|app)|(?:go|return|back|click here to return|take me) (?:back )?to (?:the )?(?:start|home|main|previous|front|last)(?:[ -]?page)?\b|if (?:you keep seeing|the problem persists|this (?:problem|error) (?:persists|continues)|you (?:think|believe) this is)|(?:contact|write to|notify|e-?mail) (?:the |our |your )?(?:site |system )?(?:desk|support|administrator|webmaster|help ?desk|owner)|(?:please )?(?:sign|log) in (?:again|to continue|to view|to see|first)|(?:please )?(?:update|upgrade) your browser|complete the captcha|clear your (?:cache|cookies)",
    "de": r"versuchen sie es\b.*|(?:bitte )?(?:laden|aktualisieren) sie (?:die|diese) seite|(?:bitte )?(?:melden sie sich|loggen sie sich)\b.*(?:erneut|wieder|neu|an|ein)|zurück zur (?:startseite|vorherigen seite)|wenden sie sich an (?:den|die|unseren)\b.*(?:administrator|support|betreiber)|später erneut",
    "fr": r"(?:veuillez )?ré-?essaye[rz]\b.*|(?:veuillez )?(?:recharger|actualiser|rechargez|actualisez) (?:la|cette) page|(?:veuillez )?(?:vous )?(?:re)?connecte[rz](?:-vous)?\b.*(?:nouveau|continuer)|retour(?:ner|nez)? à (?:la page d[’']accueil|l[’']accueil|la page précédente)|contacte[rz] (?:l[’']administrateur|le support|le webmestre)",
    "es": r"(?:por favor,? )?(?:inténtelo|intente|inténtalo)\b.*(?:nuevo|nuevamente|tarde)|recargue la página|volver al inicio", "zh": r"请?(?:您)?(?:稍后|稍候|过一会儿?|几分钟后)(?:再|重)?.{0,2}(?:试|访问|重试|刷新)|请?(?:点击)?(?:刷新|重试|重新(?:加载|登录|登陆|刷新|尝试))|请(?:先|您先)?(?:登录|登陆)(?:后|再)|返回(?:首页|主页|上一页)|(?:请)?联系(?:网站)?(?:管理员|客服)",
    "bo": r"(?:ཡང་|སླར་)?བསྐྱར་(?:དུ་)?[^\s]*(?:ཚོད་ལྟ|འབད|ནང་འཛུལ)[^\s]*|(?:ནང་འཛུལ|ཚོད་ལྟ|ཁ་ཕྱེ)[^\s]*(?:བསྐྱར|སླར)[^\s]*", "mn": r".*дахин (?:оролд|нэвтэр|ачаал|үзнэ)\w*.*|.*(?:хуудас|хөтөч)\w* (?:шинэчил|сэргээ)\w*.*",
    "hi": r"(?:कृपया )?(?:पुनः|पुन:|फिर से|दोबारा|बाद में) ?.*(?:प्रयास|प्रयत्न|कोशिश|यत्न|लॉग ?इन)\S*.*", "ru": r"(?:пожалуйста,? )?(?:попробуйте|повторите)\b.*(?:позже|снова|ещё раз|еще раз|попытку)|(?:обновите|перезагрузите) страницу|вернуться на главную|войдите снова",
}
#: A closed door: said in two or three words by sites, and in whole sentences by others.
TERSE = r"access (?:is |has been )?(?:denied|forbidden|restricted)|permission denied|forbidden|unauthori[sz]ed|not found|page not found|service unavailable|maintenance|unavailable|timeout|error|oops|(?:the |this )?[\w-]+ (?:not found|unavailable)|connection (?:lost|refused|reset|closed)|login required|captcha|zugriff verweigert|nicht gefunden|accès refusé|introuvable|nicht verfügbar|indisponible"
#: The visitor is spoken to.
ADDRESSED = re.compile(r"\b(?:you|your|you're|please|sorry|oops|we're|we are|we could|we couldn't|we cannot|we can't|ihre?n?|bitte|leider|this (?:server|site|website|page|app|browser)|vous|votre|veuillez|désolés?|usted|su|por favor|пожалуйста|вы|ваш\w*)\b|[您请]|抱歉|对不起|རོགས|ཁྱེད|कृपया|таны?\b|уу\b")
#: Told of the past, of oneself, or of what people do.
TOLD = re.compile(
    r"\b(?:i|my|me|he|she|his|her|they|their|them|was|were|had|once|said|wrote|yesterday|(?:some|many|most) (?:of|readers|people|users|visitors)|when|because|whether|means?|meant|called|ich|mein\w*|er|war|waren|hatte|gestern|manche|viele|wenn|weil|bedeutet|je|mon|ma|il|elle|était|avait|fut|hier|quand|parce|certains|signifie)\b|意思|表示|曾经|昨天|有些"
)
_QUOTED = re.compile(r"“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|‘[^’\n]{2,}’|\"[^\"\n]*\"|(?<![\w])'[^'\n]{2,}'(?!\w)|「[^」\n]*」|『[^』\n]*』|《[^》\n]*》|`[^`\n]*`")
_UNIT = re.compile(r"[^\n.!?;。！？；।॥།༎༔༑…]+(?:\.(?=\S)[^\n.!?;。！？；।॥།༎༔༑…]+)*")
_OPEN_FRAME = re.compile(r"^[\s\-–—•*#>:,，、)\]»”’\"']+")
#: Longest notice, in words; ideographs and syllables count as half of one.
WORDS = 30
_WORDS = re.compile(r"[㐀-䶿一-鿿]|[ༀ-࿿]+?(?=་|\Z|[^ༀ-࿿])|[^\W_]+(?:[’'-][^\W_]+)*")


@lru_cache(1)
def _patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern, re.Pattern, re.Pattern]:
    either = lambda parts: "|".join(f"(?:{p})" for p in parts)
    needs = re.compile(either(NEEDS[k].format(s=SCRIPT[k]) for k in NEEDS))
    fails = re.compile(either(FAILS.values()))
    acts = re.compile(rf"^(?:{either(ACTS.values())})")
    codes = "|".join(STATUS)
    named = r"(?:http(?:/\d(?:\.\d)?)?|https?-fehler|error|errore?|status|code|erreur|fehler|错误|ошибка|алдаа|त्रुटि|ནོར་འཁྲུལ་?)"
    after = rf"\s*[:\-–—|(]?\s*(?:{REASONS}|error|fehler|erreur|错误)\b"
    status = re.compile(rf"^(?:{named}[\s:#\-–]*)+\b(?:{codes})\b(?:{after}|[\s:)\]|\-–]*(?:$|[a-z]))|^(?:{codes})\b{after}|^(?:{REASONS})\s*[:\-–(]?\s*(?:{named}\s*)?(?:{codes})\b")
    terse = re.compile(rf"(?:{TERSE})(?:\s*[:\-–(]?\s*(?:ref\w*|code|id|nr|no)?\s*[#:]?\s*[\da-f\-]*\)?)?")
    return needs, fails, acts, status, terse


def patterns() -> list[str]:
    """The patterns of which every notice matches one."""
    return [*(NEEDS[k].format(s=SCRIPT[k]) for k in NEEDS), *FAILS.values(), *ACTS.values(), "(?:" + "|".join(STATUS) + ")", TERSE]


#: A number under which the site keeps the failure.
_TRACE = re.compile(r"(?:reference|trace|ref|code|id|request|incident|ray|event|correlation|support)\b.{0,12}?[\da-f]{2,}-?\d")


@lru_cache(1)
def _terse_lead() -> re.Pattern:
    return re.compile(rf"(?:{TERSE})(?=\W)")


def lead(unit: str) -> str:
    """A sentence without marks and white space at its ends."""
    return _OPEN_FRAME.sub("", unit).strip()


def is_notice(unit: str) -> bool:
    """Whether a sentence in lower case, without quotations and marks at its start, is a notice."""
    if not unit:
        return False
    needs, fails, acts, status, terse = _patterns()
    if status.search(unit) or terse.fullmatch(unit):
        return True
    if (m := _terse_lead().match(unit)) and (_TRACE.match(rest := lead(unit[m.end() :])) or is_notice(rest)):
        return True
    words = _WORDS.findall(unit)
    size = sum(0.5 if "ༀ" <= w[0] <= "࿿" or "㐀" <= w[0] <= "鿿" else 1 for w in words)
    if size > WORDS:
        return False
    addressed = bool(ADDRESSED.search(unit))
    if acts.search(unit):
        return True
    return bool(needs.search(unit) or fails.search(unit)) and (addressed or not TOLD.search(unit))


def units(low: str) -> list[tuple[int, int]]:
    return [m.span() for m in _UNIT.finditer(low)]


def unquoted(low: str) -> str:
    """The text with quotations blanked out, at the same places; the end mark of one that closes a sentence stays."""
    return _QUOTED.sub(lambda m: " " * (len(m.group()) - 2) + (m.group()[-2] if m.group()[-2] in ".!?。！？…" else " ") + " ", low)
