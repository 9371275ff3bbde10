"""Problem 4: question and answer pairs whose answer is defective, with the kind of defect.

Method: distinct answers are sorted by text over the whole collection and each is compared with the next one: an answer that is
a proper prefix of its neighbour may be a shortened version (an extension of a text always sorts directly behind it, so one
comparison finds it).  Lengths at which more unfinished answers pile up than at the lengths beside them are length limits.  These two are evidence beside the form
of the answer's end; copy, refusal and language rules follow.  An answer gets the first defect of empty, refusal, copied,
other_language, truncated that applies.

What each rule looks at (whole texts):

* empty: nothing but signs, markup, invisible characters or a stand-in for a missing value;
* refusal: one sentence declines in the first person and every other sentence is courtesy;
* copied: the answer is the question, or nearly all runs of three tokens of the answer stand in the question;
* other_language: the prose of the answer is in another language than that of the question, which names no other language;
* truncated: open code fence or bracket in code, an announced list with too few entries, an ellipsis or a joining sign at the end, or prose
  whose last sentence has no end (an answer of one sentence only where the answers of the collection in its script nearly always
  end with a sign); any other answer but a bare result counts when it is a shortened version of a longer answer,
  and an unfinished short piece also when it has a length limit's length.

Defined results: a null answer is empty; a null or missing user message can neither be copied nor set a language; a sample_id
counts once, with its latest version.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, latest_rows

#: Fixed words: stand-ins for a missing value.
STAND_INS = {
    "na", "n a", "none", "null", "nil", "nan", "empty", "unknown", "undefined", "missing", "tbd", "todo", "no answer", "not available",
    "not applicable", "no response", "blank", "placeholder", "无", "空", "暂无", "没有", "未知", "缺失", "无答案", "暂无答案", "待补充", "无内容",
    "keine", "kein", "leer", "keine antwort", "keine angabe", "k a", "ninguno", "ninguna", "nada", "vacío", "vacio", "sin respuesta", "no disponible",
}
_MARKUP = re.compile(r"<[^<>]{0,60}>|\[[/a-z_ ]{0,30}\]|```\w*")
_SIGNS = re.compile(r"[\W_]+")

_DECLINE = re.compile(
    r"\b(i|we)\b[^.!?]{0,40}\b(can ?not|can't|could not|couldn't|won't|will not|am not able|are not able|am unable|are unable|must decline|have to decline|decline|refuse|"
    r"would rather not|'d rather not|don't feel comfortable|am not allowed|am not permitted|may not|do not wish|don't wish)\b"
    r"|\b(i'm|we're) (not able|unable|not allowed|not permitted|not in a position)\b|\bi am (unable|not able)\b"
    r"|\b(beyond|outside|exceeds)\b[^.!?]{0,30}\b(i may|i can|i am|my|me|scope)\b|\bnot something i (can|may|will)\b|\bno way for (me|us)\b|\bimpossible for (me|us)\b"
    r"|恕难从命|恕不|恕我|爱莫能助|超出了?[^。！？]{0,12}(范围|权限|能力)|不在[^。！？]{0,8}(范围|权限)|请换个(问题|话题)"
    r"|\b(übersteigt|überschreitet|außerhalb)\b[^.!?]{0,40}\b(mein|meine|meiner|möglichkeiten|rahmen)\b|\bgeht über\b[^.!?]{0,40}\bhinaus\b"
    r"|\b(supera|excede|sobrepasa|fuera de|más allá de)\b[^.!?]{0,40}\b(mis|mi|lo que puedo|alcance)\b"
    r"|(我|本助手|这个话题|该话题|此话题|这个问题|该问题)[^。！？]{0,14}(不能|无法|不会|不便|不可以|不愿|不方便|拒绝|没法|难以)[^。！？]{0,10}(回答|提供|讨论|回应|帮|协助|评论|作答|处理|满足|解答|回复|说明|谈)?"
    r"|^(抱歉|对不起|不好意思|很遗憾|非常抱歉)[，,][^。！？]{0,12}(不能|无法|不会|不便|拒绝)"
    r"|\bich (kann|darf|möchte|werde|will)\b[^.!?]{0,60}\b(nicht|nichts|keine|kein|ablehnen)\b|\b(kann|darf|möchte|werde) ich\b[^.!?]{0,60}\b(nicht|nichts|keine|kein|ablehnen)\b|\b(mir|uns) (ist )?[^.!?]{0,40}\b(nicht|un)\s?möglich\b|\bich (muss|lehne)\b[^.!?]{0,60}\b(ablehnen|ab)\b"
    r"|\b(je|nous) (ne|n')[^.!?]{0,30}\b(pas|refuse)\b|\bje (refuse|regrette de ne)\b|\b(dépasse|au-delà de)\b[^.!?]{0,40}\b(mes|mon|ma|ce que je)\b|\b(il m'est|il nous est) impossible\b"
    r"|\bnon (posso|possiamo|sono in grado|mi è possibile|mi è consentito)\b|\bnão (posso|podemos|consigo|estou autorizad[oa]|me é possível)\b|\b(devo|tenho que) (rifiutare|declinare|recusar)\b"
    r"|\bno (puedo|podemos|me es posible|voy a|estoy en condiciones|debo|quiero|me está permitido)\b|\b(debo|tengo que) (declinar|rechazar|negarme|abstenerme)|\bprefiero no\b|\bme niego\b",
    re.I,
)
_ABOUT = re.compile(
    r"(beyond|outside|恕|爱莫能助|范围|权限|请换|nichts sagen|auskunft|möglich|übersteigt|überschreitet|außerhalb|hinaus|supera|excede|fuera de|más allá|answer|respon|help|assist|comment|request|discuss|provide|that|this|topic|matter|question|回答|提供|讨论|回应|帮|协助|评论|作答|处理|满足|解答|回复|话题|问题|谈|内容|"
    r"antwort|helfen|hilf|anfrage|frage|thema|beantworten|äußern|kommentieren|répond|aider|demande|sujet|commenter|fournir|aiut|rispond|richiesta|argomento|domanda|ajud|pedido|assunto|ayud|respond|petición|solicitud|pregunta|tema|comentar|contestar|respuesta|responder)",
    re.I,
)
_COURTESY = re.compile(
    r"sorry|apolog|regret|unfortunately|thank|consult|professional|expert|qualified|guideline|polic|not allow|something else|anything else|else you need|can i help|let me know|as an ai|assistant|understand"
    r"|抱歉|对不起|不好意思|遗憾|谢谢|感谢|咨询|专业人员|专业人士|规范|规定不允许|不允许|别的|其他问题|还有什么|人工智能|助手|理解|关于"
    r"|leider|tut mir leid|entschuldig|bedaure|danke|fachperson|fachleute|wenden sie sich|richtlinien|sonst noch|etwas anderes|assistent|verständnis"
    r"|désolé|navré|excuse|malheureusement|regrett|merci|consultez|professionnel|autre question|mi dispiace|spiacente|purtroppo|grazie|desculp|sinto muito|infelizmente|obrigad"
    r"|lo siento|lamento|disculp|perdón|gracias|consulte|persona experta|profesional|normas|directrices|algo más|otra cosa|asistente|comprend",
    re.I,
)
#: Pieces of which every text that _DECLINE matches has at least one: a quick test before the long pattern.
_HINTS = (
    "not", "n't", "unable", "declin", "refus", "beyond", "outside", "exceed", "no way", "impossible", "恕", "爱莫能助", "超出", "不能", "不会", "不便", "不可以", "不愿", "不方便", "不在", "无法", "拒绝",
    "没法", "难以", "请换", "nicht", "kein", "lehn", "möglich", "übersteigt", "überschreitet", "außerhalb", "hinaus", "supera", "excede", "sobrepasa", "fuera de", "más allá", "no ", "rechazar", "negarme",
    "abstenerme", "niego", "non ", "não", "pas", "regrett", "dépasse", "au-delà", "rifiut", "recus",
)
_SENTENCE = re.compile(r"[^。！？!?\n]*?(?:[。！？!?\n]+|\.(?=\s|$)|$)")
_TOKEN = re.compile(r"[一-鿿]|[^\W一-鿿]+")
_FENCE = re.compile(r"```.*?(?:```|$)", re.S)
_CODE_LINE = re.compile(r"^\s*(def |return\b|for |while |if |else:|elif |import |from \w+ import|class |print\(|\w+(\.\w+)*\(.*\)$|\w+ ?[+\-*/]?= ?\S|@\w+|#(?!#))")
_RESULT = re.compile(
    r"####\s*\S.*$|(最终答案|答案|结论)\s*[:：是为]\s*\S{1,40}$|\b(final answer|the answer|answer|antwort|respuesta|resultado|ergebnis|result)( final)?\s*(:|is|ist|es)\s*\S{1,40}$", re.I
)
_ENDS = set(".。!！?？`」』】》〉")
_CLOSERS = "\"'”’»)）]］"
_JOIN = set(",，、;；:：-–—…(（[{=+*×/&")
#: Fixed words: frequent function words by language.
WORDS = {
    "en": "the a an of and to in is was were that with for on by from at as it its not this are has had after before because which near once then into them their over each should how what who when whenever would could can will you your there many first more than be been or if but so between".split(),
    "de": "der die das und ein eine einen einem einer des dem den ist wurde wurden nicht mit auf für von zu bei nach wegen zwischen um im am an aus sind hat werden wird seit sich war als auch über vor meldet warten liegt jetzt tun soll wie warum welche wer kurz zusammen bitte danach wert fasse grund ab".split(),
    "es": "el la los las un una unos unas de del y en que es fue por para con se su al desde entre no tras luego esperan como más sin sobre está son ha qué cuál cada lo le debe hacer ahora cuando dónde quién cómo motivo brevemente resume y luego fue".split(),
    "fr": "le la les un une des du de et est en que pour dans par sur avec il elle ils nous vous je ne pas ce cette ces qui au aux sont a été était plus mais ou donc où après avant puis comme leur ses son sa c'est d'un d'une".split(),
    "it": "il lo la gli le un uno una di del della dei delle e è che non per con da dal dalla nel nella in al alla sono ha hanno questo questa come più ma dopo prima poi si sul sulla essere stato era anche".split(),
    "pt": "o a os as um uma uns umas de do da dos das e é que não para com por no na nos nas em ao à são foi foram mais mas depois antes como esta este isso ser está também pelo pela se seu sua".split(),
    "nl": "de het een en van in is dat op te zijn niet met voor aan er om ook als bij door uit maar naar wordt werd hebben heeft deze dit die dan of nog tot over".split(),
}
_WORDS = {w: [l for l in WORDS if w in WORDS[l]] for l in WORDS for w in WORDS[l]}
_ASKS = re.compile(
    r"(in|into|auf|ins|en|al|用|以|译成|翻译成|译为|翻成|使用)\s*(the )?(english|german|spanish|chinese|mandarin|french|englisch\w*|deutsch\w*|spanisch\w*|chinesisch\w*|inglés|alemán|español|chino|francés|"
    r"英文|英语|德文|德语|西班牙文|西班牙语|中文|汉语|法语|法文)|translat|übersetz|traduc|traduzc|翻译|译成|译为",
    re.I,
)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def prose(text: str) -> str:
    """The text without fenced code, lines of code and option lists."""
    kept = [x for x in _FENCE.sub("\n", text).split("\n") if not _CODE_LINE.match(x)]
    return "\n".join(kept)


_HAN = re.compile("[一-鿿]")
#: Scripts that name a language by themselves: any letter run of them outside Latin and Chinese.
_SCRIPTS = {
    "ja": re.compile("[\u3041-\u30ff]"), "ko": re.compile("[\uac00-\ud7a3\u1100-\u11ff]"), "ru": re.compile("[\u0400-\u04ff]"), "el": re.compile("[\u0370-\u03ff]"),
    "ar": re.compile("[\u0600-\u06ff]"), "he": re.compile("[\u0590-\u05ff]"), "th": re.compile("[\u0e00-\u0e7f]"), "hi": re.compile("[\u0900-\u097f]"),
}
_OTHER_SCRIPT = re.compile("[\u0370-\u06ff\u0900-\u0e7f\u1100-\u11ff\u3041-\u30ff\uac00-\ud7a3]")
_LATIN = re.compile(r"[^\W\d_一-鿿]+")
#: Letters that speak for a language, and how much a word with one counts.
_ACCENTS = {"de": (re.compile("[äöüß]"), 0.7), "es": (re.compile("[ñáíóúé]"), 0.4), "fr": (re.compile("[éèêàçùâîô]"), 0.4), "it": (re.compile("[àèìòù]"), 0.4), "pt": (re.compile("[ãõçáéíóúâêô]"), 0.4)}


def spoken(text: str) -> dict[str, float] | None:
    """Evidence per language by script, function words and accents; None when there is too little to tell."""
    body = prose(text).lower()
    han, words = len(_HAN.findall(body)), _LATIN.findall(body)
    if not body.isascii() and (odd := len(_OTHER_SCRIPT.findall(body))) >= 4:
        by = {lang: len(p.findall(body)) for lang, p in _SCRIPTS.items()}
        best = max(by, key=by.get)
        if best == "ja":
            # Japanese mixes kana with Chinese characters
            if by["ja"] >= 0.1 * (han + by["ja"]) and han + by["ja"] >= 2 * len([w for w in words if w.isascii()]):
                return {"ja": 99.0}
        elif odd >= han and odd >= sum(len(w) for w in words if w.isascii()):
            return {best: 99.0}
    if han and han >= 2 * len(words):
        return {"zh": 99.0} if han >= 4 else None
    latin = [w for w in words if len(w) > 1 or w in _WORDS]
    if han and han >= 2 * len(latin):
        return {"zh": 99.0} if han >= 4 else None
    if len(latin) < 4:
        return None
    score = dict.fromkeys(WORDS, 0.0)
    for w in latin:
        for lang in _WORDS.get(w, ()):
            score[lang] += 1.0
    if not body.isascii():
        for lang, (letters, weight) in _ACCENTS.items():
            score[lang] += weight * sum(bool(letters.search(w)) for w in latin)
    return score if max(score.values()) >= 1.5 else None


def language(text: str) -> str | None:
    """The language that the evidence speaks for clearly; None otherwise."""
    score = spoken(text)
    if not score:
        return None
    first, *rest = sorted(score, key=score.get, reverse=True)
    return first if score[first] >= 1.5 * (score[rest[0]] if rest else 0) + 0.5 else None


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    plain = unicodedata.normalize("NFKC", answer)
    bare = _SIGNS.sub(" ", _MARKUP.sub(" ", plain)).strip().lower()
    full = _SIGNS.sub(" ", plain).strip().lower()
    return not bare or bare in STAND_INS or full in STAND_INS


def is_refusal(answer: str) -> bool:
    low = answer.lower()
    if not any(h in low for h in _HINTS):
        return False
    parts = [p.strip() for p in _SENTENCE.findall(answer) if p.strip()]
    declined = False
    for p in parts:
        plain = p.replace("’", "'")
        if _DECLINE.search(plain) and _ABOUT.search(plain):
            declined = True
        elif not _COURTESY.search(plain):
            return False
    return declined


#: Fixed words that ask, and words that frame a question which is only said again.
_ASKING = set("what which who whom whose when where why how was wer wen wem wessen wann wo warum weshalb wieso wie welche welcher welches qué cuál cuáles quién cuándo dónde cómo quoi quel quelle qui quand où pourquoi comment".split()) | set("谁何吗哪怎")
_FRAME = set("the a an is are of to be that this you it asks asked asking question want wants know wish whether here i about der die das ist frage gefragt sie wissen ob el la los las es son de del lo que pregunta quiere saber si le les est une un de du".split()) | set("问题是您你想知道的所请了这个在于题目要求")


def restated(a: list[str], q: list[str]) -> bool:
    """The answer puts the question again in other words: it asks with a word of the question, says nearly all of it, and nearly
    nothing else."""
    asks = {w for w in a if w in _ASKING} & set(q)
    if not asks:
        return False
    mine, theirs = ({w.rstrip("s") for w in text if w not in _FRAME and w not in _ASKING} for text in (a, q))
    both = len(mine & theirs)
    return len(theirs) >= 2 and both >= 0.8 * len(mine) and both >= 0.6 * len(theirs)


def is_copied(question: str, answer: str, share: float = 0.8, least: int = 5) -> bool:
    a, q = tokens(answer if answer.isascii() else unicodedata.normalize("NFKC", answer)), tokens(question if question.isascii() else unicodedata.normalize("NFKC", question))
    if a[:1] in (["question"], ["frage"], ["pregunta"], ["prompt"]):
        a = a[1:]
    if a[:2] in (["问", "题"], ["题", "目"], ["提", "问"]):
        a = a[2:]
    if a and a == q:
        return True
    if len(a) < least or len(q) < 3:
        return False
    known = set(q)
    if restated(a, q):
        return True
    # a run needs all three of its tokens in the question
    if sum(w in known for w in a) < share * (len(a) - 2):
        return False
    runs = set(zip(q, q[1:], q[2:]))
    mine = list(zip(a, a[1:], a[2:]))
    return sum(r in runs for r in mine) >= share * len(mine)


def other_language(question: str, answer: str) -> bool:
    """The answer's language is none of those the question may be in, and clearly so."""
    said = spoken(answer)
    asked = spoken(question) if said else None
    if not said or not asked:
        return False
    top = max(asked.values())
    fits = [x for x, v in asked.items() if 1.5 * v + 0.5 > top]
    best = max(said, key=said.get)
    return best not in fits and said[best] >= 1.5 * max(said.get(x, 0.0) for x in fits) + 0.5 and not _ASKS.search(question)


_ANNOUNCED = re.compile(r"(?:共分|分为|分成|共有|有|包括|以下|下列)\s*([0-9]+|[一二三四五六七八九十])\s*(?:步|点|条|项|个步骤|个要点)(?=[。：:，])|\b(?:there are|in|has|takes)\s+(\d+|two|three|four|five|six|seven|eight)\s+(?:steps|points|items|parts)\s*[.:]|\b(\d+|zwei|drei|vier|fünf|sechs)\s+(?:schritte|punkte)\w*\s*[.:]|\b(?:hay|son|en)\s+(\d+|dos|tres|cuatro|cinco|seis)\s+(?:pasos|puntos)\s*[.:]", re.I)
_NUMBER = {w: i for ws in ("one two three four five six seven eight".split(), list("一二三四五六七八九十"), "eins zwei drei vier fünf sechs".split(), "uno dos tres cuatro cinco seis".split()) for i, w in enumerate(ws, 1)}


def unfinished_list(answer: str) -> bool:
    """A list announces its length, begins to count, and stops early."""
    m = _ANNOUNCED.search(answer)
    if not m:
        return False
    word = next(g for g in m.groups() if g).lower()
    said = int(word) if word.isdigit() else _NUMBER.get(word, 0)
    after = answer[m.end() :]
    seen = [int(x) for x in re.findall(r"(?:^|[\s。.;；])(\d{1,9})[.)、．](?=\s|\D)", " " + after)]
    count = 0
    for x in seen:
        if x == count + 1:
            count = x
    return 0 < count < said or (count == 0 and not after.strip())


_C_LINE = re.compile(r"[;{}]\s*(//.*)?$|^\s*(//|/\*|\*|#include|#define)|^\s*(case\b.*|default):\s*$")


def braced(code: str) -> bool:
    """Code of a language with braces and semicolons, not of Python."""
    if "{" not in code and ";" not in code and "}" not in code:
        return False
    lines = [x for x in code.split("\n") if x.strip()]
    return bool(lines) and ("{" in code or len(lines) > 1) and sum(bool(_C_LINE.search(x)) for x in lines) >= 0.6 * len(lines) and any(x.rstrip().endswith((";", "}")) or "{" in x for x in lines)


def open_code(answer: str) -> bool:
    if answer.count("```") % 2:
        return True
    whole = "\n".join(x[3:].split("\n", 1)[-1].removesuffix("```") for x in _FENCE.findall(answer)) or answer
    if braced(whole):
        bare = re.sub(r"//.*|/\*.*?\*/|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"", "", whole, flags=re.S if "/*" in whole else 0)
        return any(bare.count(o) > bare.count(c) for o, c in ("()", "[]", "{}")) or not bare.rstrip().endswith((";", "}"))
    if re.search(r"```(?!python|py\b)[a-z+#]+\s*\n", answer, re.I):
        return False
    code = "\n".join(x[3:].split("\n", 1)[-1].removesuffix("```") for x in _FENCE.findall(answer))
    if not code:
        lines = [x for x in answer.split("\n") if x.strip()]
        if not lines or not _CODE_LINE.match(lines[0]) or len(lines) < 2 or sum(bool(_CODE_LINE.match(x)) for x in lines) < 0.6 * len(lines):
            return False
        code = answer
    bare = re.sub(r"#.*|'[^'\n]*'|\"[^\"\n]*\"", "", code)
    last = code.rstrip().rsplit("\n", 1)[-1].strip()
    if any(bare.count(o) > bare.count(c) for o, c in ("()", "[]", "{}")) or last.endswith((":", "=", ",", "+", ".", "\\")):
        return True
    try:
        compile(code, "answer", "exec")
    except SyntaxError as e:
        return e.lineno is not None and e.lineno >= code.rstrip().count("\n") + 1
    except (ValueError, RecursionError, MemoryError, OverflowError):
        return False
    # a function that fills a result and never gives it back stopped too early
    return bool(re.search(r"^\s*def ", code, re.M)) and not re.search(r"^\s*(return|yield|print|raise|pass)\b", code, re.M)


def is_code(answer: str) -> bool:
    if braced(answer):
        return True
    lines = [x for x in answer.split("\n") if x.strip()]
    return bool(lines) and sum(bool(_CODE_LINE.match(x)) for x in lines) >= 0.6 * len(lines) and len(lines) > 1


#: Fixed words that cannot end a sentence.
_LINKS = set("the a an of and to with for from by at as or but if because between into their your than eine einen einem einer des dem den mit für von zu bei wegen zwischen und oder el los las un unos unas de del y por para con su al entre le les une des du et pour dans avec il lo gli di che per os um uma em het een van en op te voor".split()) | set("的和与及把被将从向对为")


def end_state(answer: str) -> str:
    """``cut``: certainly unfinished; ``unended``: one sentence without a sign at its end, which in most collections, but not in
    all, means the same; ``open``: without an end but short; ``done``."""
    text = answer.rstrip()
    text = re.sub("[\\u200b-\\u200f\\u2060\\ufeff\\s]+$", "", text)
    if not text:
        return "done"
    if open_code(text) or unfinished_list(text):
        return "cut"
    if text.endswith("```") or is_code(text):
        return "done"
    if text.endswith(("...", "…")) or text[-1] in _JOIN:
        return "cut"
    core = text.rstrip(_CLOSERS)
    if text.count("(") + text.count("（") > text.count(")") + text.count("）") and not text[-1] in _CLOSERS:
        return "cut"
    if core and core[-1] in _ENDS:
        return "done"
    last = text.rsplit("\n", 1)[-1].strip()
    if _RESULT.search(last):
        # a result line that gives only the first digits of the result just computed
        m = re.fullmatch(r"####\s*(\d+)", last)
        before = re.findall(r"\d+", text[: len(text) - len(last)]) if m else []
        return "cut" if before and before[-1] != m.group(1) and before[-1].startswith(m.group(1)) else "done"
    if re.fullmatch(r"#{1,4}", last):
        return "cut"
    pieces = [p.strip() for p in _SENTENCE.findall(text) if p.strip()]
    tail = tokens(pieces[-1]) if pieces else []
    if len(pieces) == 1:
        if len(tail) >= 4 and tail[-1] in _LINKS:
            return "cut"
        if len(tail) >= (9 if re.search("[一-鿿]", pieces[0]) else 6) or re.search(r"[,，]", pieces[0]):
            return "unended"
        return "open" if len(tail) >= 5 else "done"
    if re.fullmatch(r"[A-Da-d]|[-+]?[\d.,]+ ?%?", last):
        return "done"
    return "cut"


def is_bare(answer: str) -> bool:
    """Only a result or an option letter, or an end in a result line: a longer answer that begins alike does not continue it."""
    text = answer.strip()
    if _RESULT.search(text.rsplit("\n", 1)[-1].strip()):
        return True
    words = tokens(text)
    if len(words) >= 5 or is_code(text) or text.endswith("```"):
        return False
    return text.rstrip(_CLOSERS)[-1:] not in _ENDS or any(w in "abcd" or w[0].isdigit() for w in words)


def row_defect(question: str | None, answer: str | None) -> tuple[str | None, str | None]:
    """The defect that the pair shows by itself; without one, what the collection may decide: ``unended``, ``open``, ``done``, or
    None for a bare result."""
    if is_empty(answer):
        return "empty", None
    if is_refusal(answer):
        return "refusal", None
    if question and is_copied(question, answer):
        return "copied", None
    if question and other_language(question, answer):
        return "other_language", None
    state = end_state(answer)
    if state == "cut":
        return "truncated", None
    return None, None if state == "done" and is_bare(answer) else state


def ending(answer: str | None) -> str | None:
    """Script of the prose of an answer that is neither defective by itself, code nor a bare result, and whether it has an end:
    the habit of a collection is the share of these that have one."""
    text = (answer or "").rstrip()
    if not text or is_code(text) or text.endswith("```") or is_bare(text) or len(tokens(text)) < 2:
        return None
    return ("han" if _HAN.search(text) else "other") + ("+" if text.rstrip(_CLOSERS)[-1:] in _ENDS else "-")


def pairs(data: DataFrame) -> DataFrame:
    """rid, question (the last user message) and answer."""
    slim = data.select(
        F.col("sample_id").alias("rid"), F.col("created_ts").alias("_ts"),
        F.try_element_at(F.filter("messages", lambda m: m["role"] == "user"), F.lit(-1))["content"].alias("question"), "answer",
    ).filter("rid is not null")
    return latest_rows(slim, "rid", "_ts", ["question", "answer"]).drop("_ts")


def shortened(answers: DataFrame) -> DataFrame:
    """(answer_hash) of the distinct answers that are a proper prefix of another answer.

    Sorted by bytes, an extension follows its prefix directly.  The sort is a range partitioning; the last text of a partition
    is compared with the first of the next, from a list of one row per partition.
    """
    ordered = cut_lineage(
        answers.filter("length(answer) > 0").groupBy("answer").agg(F.lit(1).alias("_one")).select("answer").repartitionByRange("answer")
        .sortWithinPartitions("answer").withColumn("pid", F.spark_partition_id())
    )

    def run(batches):
        held, pid = None, None
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if not texts:
                continue
            pid = batch.column(1)[0].as_py()
            full = ([held] if held is not None else []) + texts
            found = [x for x, y in zip(full, full[1:]) if y.startswith(x)]
            held = texts[-1]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([pid] * len(found), pa.int32()), pa.array([False] * len(found), pa.bool_())], names=["answer", "pid", "last"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.string()), pa.array([pid], pa.int32()), pa.array([True], pa.bool_())], names=["answer", "pid", "last"])

    met = ordered.mapInArrow(run, "answer string, pid int, last boolean")
    firsts = ordered.groupBy("pid").agg(F.min("answer").alias("head")).withColumn("before", F.lag("pid").over(Window.orderBy("pid")))
    edge = met.filter("last").join(firsts.selectExpr("before pid", "head"), "pid").filter("startswith(head, answer)")
    return met.filter("not last").select("answer").union(edge.select("answer")).select(F.xxhash64("answer").alias("answer_hash")).distinct()


def length_limits(judged: DataFrame, share: float = 0.5, times: float = 4.0, near: int = 5) -> DataFrame:
    """(n_chars) of the lengths at which cut answers pile up, whatever the size of the table.

    More than one answer of the length is certainly cut, these make up ``share`` of that length, and they are at least ``times``
    as many as the mean of the ``near`` lengths on either side.
    """
    by = judged.groupBy("n_chars").agg(F.count("*").alias("n"), F.count_if(F.col("defect") == "truncated").alias("cut"))
    piles = by.filter((F.col("cut") > 1) & (F.col("cut") >= F.lit(share) * F.col("n")))
    beside = by.filter("cut > 0").select(F.explode(F.array(*[F.col("n_chars") + d for d in range(-near, near + 1) if d])).alias("n_chars"), F.col("cut").alias("other"))
    around = beside.groupBy("n_chars").agg((F.sum("other") / (2 * near)).alias("mean"))
    return piles.join(around, "n_chars", "left").filter(F.col("cut") >= F.lit(times) * F.coalesce("mean", F.lit(0.0))).select("n_chars")


def defects(data: DataFrame, habit_share: float = 0.75) -> DataFrame:
    """(sample_id, defect) of each defective pair."""
    rows = pairs(data)

    def run(batches):
        for batch in batches:
            answers = batch.column("answer").to_pylist()
            made = [row_defect(q, a) for q, a in zip(batch.column("question").to_pylist(), answers)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rid"), pa.array([d for d, _ in made], pa.string()), pa.array([x for _, x in made], pa.string()),
                    pa.array([len(a or "") for a in answers], pa.int64()), batch.column("answer_hash"), pa.array([None if d or x is None else ending(a) for a, (d, x) in zip(answers, made)], pa.string()),
                ],
                names=["rid", "defect", "state", "n_chars", "answer_hash", "ending"],
            )

    keyed = rows.withColumn("answer_hash", F.xxhash64("answer")).select("rid", "question", "answer", "answer_hash")
    kind = rows.schema["rid"].dataType.simpleString()
    judged = cut_lineage(keyed.mapInArrow(run, f"rid {kind}, defect string, state string, n_chars long, answer_hash long, ending string").distinct())
    sure = judged.filter("defect is not null").select("rid", "defect")
    short = judged.filter("state is not null").join(shortened(rows.select("answer")), "answer_hash", "left_semi").select("rid")
    # copies of an answer have one length anyway; they are one answer here
    limits = length_limits(judged.select("n_chars", "defect", "answer_hash").distinct())
    # an unended sentence is a cut one where the collection ends its sentences
    habit = judged.filter("ending is not null").select("ending", "answer_hash").distinct().groupBy(F.expr("rtrim('+-', ending)").alias("script")).agg(
        F.avg(F.endswith("ending", F.lit("+")).cast("double")).alias("share")
    )
    strict = [r["script"] for r in habit.filter(F.col("share") >= habit_share).collect()]  # two scripts at most
    unended = judged.filter(F.col("state") == "unended").filter(F.expr("rtrim('+-', ending)").isin(strict)).select("rid")
    spike = judged.filter("state in ('open', 'unended')").join(limits, "n_chars", "left_semi").select("rid")
    found = sure.union(short.union(spike).union(unended).select("rid", F.lit("truncated").alias("defect")))
    return found.groupBy(F.col("rid").alias("sample_id")).agg(F.min("defect").alias("defect"))


def defect_report(data: DataFrame) -> DataFrame:
    """Pairs by dataset and defect (null for sound pairs)."""
    by = data.select("sample_id", "dataset_key").filter("sample_id is not null").groupBy("sample_id").agg(F.min("dataset_key").alias("dataset_key"))
    return by.join(defects(data), "sample_id", "left").groupBy("dataset_key", "defect").agg(F.count("*").alias("pairs"))


