"""Defects of prompt-response pairs: empty, truncated, refused, copied, other language."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainsieve.llm.words import words

# Function words by language, without marks.
FUNCTION_WORDS = {
    "en": "the of and to in is that for we with by on each this are be as from so at it its which into only was were "
    "not if then than but since he she they his her their what how many you i my me your have has had there",
    "es": "el la los las que de en por con una un es para se del como lo su sus al mas entre cuando tiene nos hay "
    "son esta este pero si cada otro otra cuantas cuantos asi luego primero desde",
    "fr": "le la les et est une un des dans pour que du avec nous il on cette ce ces par sur au aux ainsi donc qui "
    "plus pas de ensuite chaque faut reste si d l c",
    "de": "der die das und ist ein eine mit auf den von zu nicht im wir des dem dass damit als um fur noch wird "
    "werden durch also weil sich jede genau bleiben einige",
    "pt": "o os as que em um uma para com nao do da dos das ao na no mais entao temos cada se por e foi sao mas",
    "it": "il lo gli che di un una per con non del della dei e sono si nel alla come piu quindi ogni abbiamo ha",
    "vi": "la va cua cac mot co duoc cho voi trong nay khong ta so phai de ban con lai se thi nen hay nhu vay do "
    "moi nhieu bao hai dau tu sau khi vi bai toan dap ve vai ngay",
    "nl": "het een en van is dat niet op te met voor zijn aan er wordt dus elke we deze uit bij om als",
    "pl": "i w na z jest nie to sie do ze dla jak po od wiec kazdy oraz przez",
    "tr": "bir ve bu ile icin olarak da de her daha ise kadar olan sonra gore",
    "id": "yang dan di untuk dengan dari adalah ini itu pada kita ke tidak jadi setiap maka",
}
# First and last code points of scripts that tell a language by themselves.
SCRIPTS = {
    "ru": [(0x400, 0x52F)],
    "el": [(0x370, 0x3FF)],
    "ar": [(0x600, 0x6FF)],
    "he": [(0x590, 0x5FF)],
    "hi": [(0x900, 0x97F)],
    "th": [(0xE00, 0xE7F)],
    "ko": [(0xAC00, 0xD7AF), (0x1100, 0x11FF)],
    "ja": [(0x3040, 0x30FF)],
    "zh": [(0x4E00, 0x9FFF), (0x3400, 0x4DBF)],
}
_LANGUAGES = {name: frozenset(text.split()) for name, text in FUNCTION_WORDS.items()}
_SCRIPT = {n: re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in r) + "]") for n, r in SCRIPTS.items()}
_LETTERS = re.compile(r"[^\W\d_]+")
_ASCII = re.compile(r"[\x00-\x7f]*\Z")
_MATH = re.compile(r"\$[^$]*\$|\\\(.*?\\\)|\\\[.*?\\\]|\\[A-Za-z]+", re.S)
_SEGMENT = re.compile(r"(?<=[.!?;])\s+|\n+|(?<=[。！？；])")


def fold(text: str) -> str:
    """Lower case, without marks; the letters d with stroke and sharp s spelt out."""
    low = text.lower()
    if _ASCII.match(low):
        return low
    plain = "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c))
    return plain.replace("đ", "d").replace("ß", "ss").replace("ı", "i")


def languages(text: str) -> Counter:
    """Words (for scripts without spaces: letters) of ``text`` by language, segment by segment.

    A segment counts for the language whose script it is written in, or whose
    function words it holds most of; segments that show none are left out.
    """
    found: Counter = Counter()
    plain = _MATH.sub(" ", text)
    for segment in _SEGMENT.split(plain):
        letters = sum(c.isalpha() for c in segment) if not _ASCII.match(segment) else 0
        if letters:
            scripts = {n: len(p.findall(segment)) for n, p in _SCRIPT.items()}
            name, most = max(scripts.items(), key=lambda x: x[1])
            if most * 2 > letters:
                if name == "zh" and scripts["ja"]:
                    name = "ja"
                found[name] += max(1, most // 2)
                continue
        tokens = _LETTERS.findall(fold(segment))
        hits = {n: sum(t in known for t in tokens) for n, known in _LANGUAGES.items()}
        best = max(hits.values(), default=0)
        if best >= 2 or (best == 1 and len(tokens) <= 6):
            leaders = [n for n, k in hits.items() if k == best]
            for name in leaders:
                found[name] += len(tokens) / len(leaders)
    return found


#: Share of function words of one language from which on a text is plainly in it.
PLAIN = 0.22


def mostly_other(text: str, asked: str | None) -> bool:
    """Most of ``text`` is in another language than ``asked``."""
    if not asked:
        return False
    if asked in _LANGUAGES:
        tokens = _LETTERS.findall(fold(_MATH.sub(" ", text)))
        if sum(map(_LANGUAGES[asked].__contains__, tokens)) > PLAIN * len(tokens):
            return False
    given, share = dominant(text)
    return given is not None and given != asked and share > 0.5


def dominant(text: str) -> tuple[str | None, float]:
    """The language most of ``text`` is in, and its share of what shows a language."""
    found = languages(text)
    if not found:
        return None, 0.0
    name, weight = found.most_common(1)[0]
    return name, weight / found.total()


# Words that alone make no content.
PLACEHOLDERS = frozenset(
    "answer final solution result none null nan na nil undefined todo tbd empty response output boxed begin end think "
    "text the is placeholder pending missing unknown step respuesta solucion dap an loi giai antwort losung reponse".split()
)
_NOT_APPLICABLE = re.compile(r"\bn\s*/\s*a\b|\bn\.\s*a\.", re.I)


def is_empty(text: str | None) -> bool:
    """No content beyond blanks, marks, headings or placeholders."""
    if text is None:
        return True
    if any(c.isdigit() for c in text):
        return False
    return all(m.group() in PLACEHOLDERS for m in _LETTERS.finditer(fold(_NOT_APPLICABLE.sub(" ", text))))


# How a final answer is written.
_FINAL = re.compile(
    r"\\f?boxed\s*\{|####\s*[^\s#]|(?:final\s+)?answer\s*(?:is|:)\s*\**\s*[^\s*:.]|answer\s*:\s*\S"
    r"|respuesta\s*(?:final)?\s*(?:es|:)\s*\S|(?:đáp số|đáp án)\s*(?:là|:)\s*\S",
    re.I,
)
# A command of which only the beginning is there.
_CUT_COMMAND = re.compile(r"\\[A-Za-z]*\Z")


def _closed(line: str) -> bool:
    """No formula, box or bracket is still open at the end of ``line``, nor a command begun."""
    plain = line.replace("\\$", "").replace("\\{", "").replace("\\}", "")
    return (
        plain.count("{") <= plain.count("}")
        and plain.count("$") % 2 == 0
        and plain.count("\\(") <= plain.count("\\)")
        and plain.count("\\[") <= plain.count("\\]")
        and not _CUT_COMMAND.search(plain)
    )


def final_answer_end(text: str) -> int:
    """Where the last final answer ends, or -1 if there is none that is complete."""
    last = -1
    for m in _FINAL.finditer(text):
        at = m.end()
        if m.group().rstrip().endswith("{"):
            depth, k = 1, at
            while k < len(text) and depth:
                depth += (text[k] == "{") - (text[k] == "}")
                k += 1
            if depth or not text[at : k - 1].strip():
                continue
            last = k
        else:
            line = text.find("\n", at)
            end = len(text) if line < 0 else line
            if _closed(text[m.start() : end]):
                last = end
    return last


def has_final_answer(text: str) -> bool:
    """A complete final answer stands at the end: after it there is at most a closing remark."""
    stripped = text.rstrip()
    end = final_answer_end(stripped)
    if end < 0:
        return False
    rest = stripped[end:].strip(" \n\t$.)]*}\\”\"'")
    return len(rest) <= 40 and "\n" not in rest and not rest.endswith((",", ":", "="))


# Phrases of refusal; they count only without a final answer.
_REFUSALS = re.compile(
    r"\b(?:i|we)(?:'m| am| are|'d| would)?\s+(?:really |simply |just )?(?:sorry\b.{0,40}?\b(?:can|cannot|won)|"
    r"(?:can ?not|can't|won't|will not|could not|couldn't|must decline|have to decline|decline to|refuse to|rather not|"
    r"prefer not|not able to|unable to|not allowed to|not permitted to|not in a position to|not going to|not comfortable|"
    r"have to pass|need to pass|will pass|must pass)\b)"
    r"(?:.{0,40}?\b(?:help|assist|answer|solve|respond|process|complete|work|continue|provide|do|discuss|engage|"
    r"comply|fulfil|fulfill|support|handle|share|give|attempt|address|on|with)\b)"
    r"|\b(?:that|understand that|please note that) i (?:refuse|decline|cannot|can't|won't)\b"
    r"|not possible for me to\b|impossible for me to\b|beyond what i (?:can|may)\b|outside what i (?:can|may)\b"
    r"|guidelines (?:don't|do not|forbid|prevent|prohibit)|policy (?:doesn't|does not|forbids|prevents)|against my (?:guidelines|policy|rules)"
    r"|stays? unanswered|remain(?:s)? unanswered|leave this \w+ aside|without me\b|for safety reasons|as an ai\b|as a language model"
    r"|(?:i'm|i am) not allowed\b|won't be able to|will not be able to|\bi must refuse|have to refuse|no puedo (?:ayudar|responder|resolver)"
    r"|lo siento,? pero|tôi không thể|xin lỗi,? (?:nhưng )?(?:tôi|mình)|je ne peux pas|ich kann (?:dir |ihnen )?(?:dabei |das )?nicht",
    re.I | re.S,
)


def is_refusal(text: str) -> bool:
    """Declines to answer; texts that come to a final answer do not count."""
    return not has_final_answer(text) and bool(_REFUSALS.search(text.replace("’", "'")))


#: A copy compressed against its prompt takes at most this share of its plain size.
COPY_RATIO = 0.62
#: Share of the longer of the two in common words that makes a copy.
COPY_WORDS = 0.6
#: The same for a response that holds the prompt several times.
COPIES_WORDS = 0.85


def copy_ratio(question: list[str], text: list[str]) -> float:
    """Compressed size of the words of ``text`` with ``question`` as dictionary, against that without."""
    a, b = " ".join(question).encode(), " ".join(text).encode()
    if len(a) < 8 or not b:
        return 1.0
    prompt = zstandard.ZstdCompressionDict(a, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    small = zstandard.ZstdCompressor(level=1, dict_data=prompt, write_content_size=False).compress(b)
    return len(small) / len(zstandard.ZstdCompressor(level=1, write_content_size=False).compress(b))


def is_copy(question: str | None, text: str) -> bool:
    """Gives back the question, once or several times, perhaps with a few words changed or added, and no solution.

    The size of the response when compressed against the prompt finds it, the common
    words confirm it: as many as a copy, or so many copies as its length asks for, would have.
    """
    if not question:
        return False
    asked, given = words(question), words(text)
    if not asked or not given:
        return False
    times = max(1, round(len(given) / len(asked)))
    least = COPY_WORDS if times == 1 else COPIES_WORDS
    a, b = Counter(asked), Counter(given)
    shared = sum(min(n, times * a[w]) for w, n in b.items() if w in a)
    if shared < least * max(times * len(asked), len(given)):
        return False
    return copy_ratio(asked, given) <= COPY_RATIO


# Marks that end a sentence, and words after which none ends.
_ENDS = ".!?。！？…؟।"
_CLOSERS = " \t\n\"'”’)]*_`»>}$"
# A list number that nothing follows, and an end without blanks (a formula or loop that was cut).
_BARE_MARKER = re.compile(r"(?:\A|\n|[.!?]\s+)\s*(?:Step\s+)?(?:\d+[.):]|\(\d+\)|[-*•])\s*\Z")
_UNBROKEN = re.compile(r"[!-~]{60}\Z")
_OPEN = re.compile(r"\\begin\{(\w+\*?)\}|\\end\{(\w+\*?)\}")


def is_truncated(text: str) -> bool:
    """Breaks off in mid-sentence or mid-formula, without a complete final answer.

    The terminal context decides: what mark the last line ends with, whether a
    formula, bracket or environment is still open there, and whether a list number
    or an unbroken run of signs is all that stands at the end.
    """
    if has_final_answer(text):
        return False
    tail = text.rstrip()
    if not tail:
        return False
    opened = 0
    for m in _OPEN.finditer(tail):
        opened += 1 if m.group(1) else -1
    last = tail[tail.rfind("\n") + 1 :]
    formula = last.replace("\\$", "").count("$") % 2 == 1 or tail.count("\\[") > tail.count("\\]") or tail.count("\\(") > tail.count("\\)")
    if opened > 0 or formula or _BARE_MARKER.search(tail) or _UNBROKEN.search(tail):
        return True
    return tail.rstrip(_CLOSERS)[-1:] not in tuple(_ENDS)


def ends_with(text: str, answer: str | None) -> bool:
    """The recorded final answer is what the text ends with, apart from closing marks."""
    if not answer or not answer.strip() or not _closed(text[text.rfind("\n") + 1 :]):
        return False
    return text.rstrip(_CLOSERS + ".})]\\").endswith(answer.strip().rstrip(_CLOSERS + ".})]\\"))


def defects(question: str | None, text: str | None, asked: str | None = None, answer: str | None = None) -> list[str]:
    """The defects of one pair, in alphabetical order; none for a proper answer.

    ``asked`` is the language of the question, where the caller knows it, ``answer``
    the final answer recorded for the response: a text that ends with it is complete.
    """
    if is_empty(text):
        return ["empty"]
    if is_copy(question, text):
        return ["copy"]
    found = []
    if mostly_other(text, asked or dominant(question or "")[0]):
        found.append("language")
    if not has_final_answer(text) and not ends_with(text, answer):
        if is_refusal(text):
            found.append("refusal")
        elif is_truncated(text):
            found.append("truncated")
    return found


def pair_defects(df: DataFrame, key: str, question: str, text: str, answer: str | None = None) -> DataFrame:
    """``key`` and ``defect`` of every defective pair, one row for each defect.

    Null texts are ``empty``; a null question can be neither copied nor of another
    language; a null ``answer`` tells nothing.  Repeated rows give their defects once.  Texts are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[str, str | None] = {}
        for batch in batches:
            keys, names = [], []
            if len(asked) > 20_000:
                asked.clear()
            for k, q, t, final in zip(*(c.to_pylist() for c in batch.columns)):
                if q is not None and q not in asked:
                    asked[q] = dominant(q)[0]
                for name in defects(q, t, asked.get(q), final):
                    keys.append(k)
                    names.append(name)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, batch.column(0).type), pa.array(names, pa.string())], names=[key, "defect"]
            )

    kind = dict(df.dtypes)[key]
    final = F.col(answer).cast("string") if answer else F.lit(None).cast("string")
    return df.select(key, question, text, final.alias("_final")).mapInArrow(run, f"`{key}` {kind}, defect string").distinct()


def defect_counts(found: DataFrame) -> DataFrame:
    """Number of pairs by defect."""
    return found.groupBy("defect").agg(F.count(F.lit(1)).alias("n_pairs"))
