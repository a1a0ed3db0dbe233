"""The citation grammar: rules in a small notation, expanded to regular expressions.

In a rule a blank stands for white space, ``~`` for white space that may be absent,
``@name`` for another rule and ``‹word|two words›`` for words as a scanner may have
read them, in any case and with or without accents; everything else is a regular
expression. The expansion tries longer alternatives first, ties in text order, so
it is the same in every process.
"""

from __future__ import annotations

import functools
import re
import unicodedata

from citescan.functions import lexicon as L

# What a scanner may read for a letter.
READ_AS = {
    "a": "aáàâãä", "c": "cçe", "e": "eéêèëc", "i": "iíìîïl1", "l": "l1iI|", "n": "nñ", "o": "oóòôõö0", "s": "s5", "u": "uúùûü",
}


def letter(char: str) -> str:
    """One letter, with what may stand for it."""
    bare = unicodedata.normalize("NFD", char)[0]
    reads = READ_AS.get(bare, bare)
    return "[" + re.escape(reads if char in reads else reads + char) + "]"


def tolerant(words: str) -> str:
    """Words as a scanner may have read them; m and rn stand for each other."""
    words = " ".join(words.lower().split())
    special = {" ": r"\s+", "m": "(?:m|rn)", "rn": "(?:rn|m)"}
    pieces = re.findall(r"rn|.", words)
    return "".join(special.get(p) or (letter(p) if p.isalpha() else re.escape(p)) for p in pieces)


def either(options) -> str:
    """The longest option first."""
    return "(?:" + "|".join(sorted(set(options), key=lambda x: (-len(x), x))) + ")"


def _short_word(word: str) -> str:
    """A word of a class name, or its first two to four letters and a full stop."""
    if word.lower() in {"de", "do", "da", "dos", "das", "em", "e", "no", "na"} or len(word) < 4:
        return either([tolerant(word)])
    return either([tolerant(word), *(tolerant(word[:n]) + r"\." for n in (2, 3, 4))])


def class_name(name: str) -> str:
    return r"\s+".join(map(_short_word, name.split()))


def class_code(code: str) -> str:
    """A code, with full stops and blanks allowed between its parts; codes of two letters keep their case."""

    def spaced(text: str) -> str:
        parts = re.findall(r"[A-Z][a-z]*|[a-z]+|\d+|-", text)
        return r"\.?\s?".join(r"\s*-\s*" if p == "-" else p for p in parts) + r"\.?"

    if len(code.replace("-", "")) > 2:
        return spaced(code)
    return f"(?-i:{either([spaced(code), spaced(code.upper())])})"


def _endings(*stems: str) -> str:
    return "|".join(s + e for s in stems for e in ("o", "a", "os", "as"))


# The forms of citations.
RULES: dict[str, str] = {
    # numbers
    "digit": r"[0-9OoDQIl|iZzSsGbTBgq]",
    "group": r"(?:[0-9]|(?<![^\W\d_])[OoDQIl|iZzSsGbTBgq](?=[.\s\-]{0,2}[0-9]))@digit*",
    "number": r"@group(?:[\s.\-–—]{1,4}@group){0,8}",
    "gap": r"[\s.\-–—]{0,3}",
    "cnj": r"@digit{7}@gap@digit{2}@gap@digit{4}@gap@digit@gap@digit{2}@gap@digit{4}",
    "ordinal_letter": r"(?<![^\W\d_])[OoDQIl|iZzSsGbTBgq](?=\s?[º°])",
    "short_number": r"(?:@group(?:\.\s?@digit{3})?|@ordinal_letter)",
    "small_number": r"(?:@group|@ordinal_letter)",
    "marker": r"(?:n\.?\s?[º°o]\.?|n\.|‹número›|(?-i:N[º°o]?\.?|No\.?))",
    "year": r"(?:19|2[0O])@digit{2}",
    # courts and states
    "uf_code": "(?-i:" + either(L.UFS) + ")",
    "uf": r"(?:~[/\-–—]~@uf_code\b|~\(~@uf_code~\))",
    "court": "(?:" + either([f"(?-i:{either(L.COURT_CODES)})", "‹" + "|".join(L.COURT_NAMES) + "›"]) + ")",
    # cases
    "hyphen": r"~-~",
    "code": "(?:" + either(map(class_code, L.PREFIX_CODES)) + "(?=[A-Z]))?" + either(class_code(c) for c in L.CLASS_CODES if c not in L.CHAIN_CODES),
    "chained": "(?:@code|" + "|".join(map(class_code, L.CHAIN_CODES)) + ")",
    "name": either(map(class_name, L.CLASS_NAMES)),
    "unit": r"(?:@name|(?:@chained@hyphen)+@chained|@code(?: ‹eleitoral|criminal|cível|trabalhista|militar›)?)",
    "class": r"(?:‹primeiro|segundo|terceiro|quarto|quinto|sexto› )?@unit(?: ‹no|na|nos|nas|em› @unit){0,5}",
    "case_word": r"(?:‹processo› (?:@marker~)?)",
    "processo": r"\b@case_word?(?:TST@hyphen)?@class(?:@hyphen|~@marker~| )@number@uf?",
    "numero_cnj": r"(?<![\w.\-])@case_word?@cnj@uf?(?![\w])",
    # precedents
    "sumula_word": r"(?:‹enunciado›|‹súmula›|‹súm›\.|(?-i:SV))",
    "sumula": r"\b@sumula_word(?: ‹vinculante›)?(?:~@marker)?~@short_number\b(?:~[/\-,]?~(?:‹do|da› )?@court)?",
    "sumula_reversed": r"\b‹verbete|enunciado›(?:~@marker)?~@short_number ‹da|de› ‹súmula›(?: ‹vinculante›)?(?: (?:‹do|da|deste|desta› )?@court)?",
    "tema": r"\b‹tema›(?:~@marker)?~@short_number\b(?: ‹da|do|dos› (?:‹repercussão geral|recursos repetitivos|recurso repetitivo›|@court))?",
    "orientacao": r"\b(?:‹orientação jurisprudencial›|(?-i:OJ))(?:~@marker)?~\d{1,4}\b(?: ‹da|do› @court)?",
    # laws
    "capital": r"(?-i:(?:[A-ZÀ-Ý][a-zà-ÿ]+|[A-ZÀ-Ý]{2,}))",
    "of": r"‹de|do|da|dos|das›",
    "article_word": r"(?:‹artigo›s?|‹art›s?\.?)",
    "sign": r"(?:\s?[º°o](?![a-z]))?",
    "article_number": r"@short_number@sign(?:\s?-\s?[A-Z]\b)?",
    "roman": r"(?-i:[IVXLCDM]{1,7}\b)",
    "part": r"(?:§{1,2}~@small_number@sign(?:\s?-\s?[A-Z]\b)?|‹parágrafo único›|‹alínea› ['\"‘’]?[a-z]['\"‘’]?|‹inciso› @roman|‹inc›\.~@roman|‹caput›|['\"‘’][a-z]['\"‘’]|@roman|(?-i:[a-z]\)))",
    "numbered_law": r"(?:(?:‹lei›|(?-i:LC))(?: ‹complementar|ordinária|federal|estadual›)?|‹decreto›(?:-‹lei›)?|‹medida provisória›)(?:~@marker)?~\d{1,2}(?:\.?\s?\d{3})*(?:~/~\d{2,4}|, ‹de› \d{4})?",
    "code_of": r"‹código›(?: (?:@of )?@capital){1,4}",
    "constitution": r"(?:‹constituição›(?: (?:‹da› )?@capital){0,2}(?: ‹de› (?:19)?88)?|‹Carta Magna|Carta da República|Carta Política|Lei Maior›)",
    "statute": r"‹estatuto› @of @capital(?: (?:(?:@of|e) )?@capital){0,3}",
    "law_code": "(?-i:" + either(map(re.escape, L.LAW_CODES)) + r")(?![\w/])",
    "law": r"(?:@numbered_law|@constitution|@statute|@law_code|@code_of|‹Consolidação das Leis do Trabalho›)",
    "dispositivo_legal": r"\b@article_word~@article_number(?:~,?~@part)*~,? (?:@of|‹desta|deste|dessa|desse›) @law",
    # decisions by description
    "decision": r"(?:@class|‹julgado|julgados|acórdão|acórdãos|aresto|arestos|precedente|precedentes|decisão|decisão monocrática›|‹entendimento|julgamento|voto condutor|voto›)",
    "decided": "‹" + "|".join(v + e for v in ("julgad", "proferid", "publicad", "prolatad", "firmad", "exarad", "fixad", "realizad", "lavrad") for e in "oa") + "›",
    "by_court": r"(?:@decided )?‹do|da|dos|das|pelo|pela|no|na› @court",
    "in_year": r"(?:@decided )?‹em|de› (?:‹ano› ‹de› )?@year\b",
    "name_word": r"(?-i:[A-ZÀ-Ý][A-Za-zÀ-ÿ'’]+)",
    "person": r"@name_word(?: (?:(?-i:de|da|do|dos|das|De|Da|Do|Dos|Das|DE|DA|DO|DOS|DAS|e) )?@name_word){0,5}",
    "judge": r"(?:‹ministro|ministra|desembargador|desembargadora|juiz|juíza›|‹min|des›\.)",
    "excellency": r"(?:‹exmo|exma›\.? (?:‹sr|sra›\.? )?)",
    "rapporteur": r"(?:(?:(?:‹pela|sob|da|de|com› (?:a )?)?‹relatoria› @of|‹relatado|relatada› ‹pelo|pela›|‹rel|relator|relatora›\.?)(?: @excellency)?(?: @judge){0,2}|‹do|da|pelo|pela›(?: @excellency)?(?: @judge){1,2}) @person",
    "comma": r"~,?~",
    "two_details": r"(?:@comma@by_court@comma(?:@in_year|@rapporteur)|@comma@in_year@comma(?:@rapporteur|@by_court)|@comma@rapporteur@comma(?:@in_year|@by_court))",
    "decisao_descritiva": r"(?<!\d\s)(?<![\d.])\b(?:‹recente› )?@decision@two_details(?:@comma(?:@by_court|@in_year|@rapporteur)){0,2}",
    # how decisions name their own case
    "dash": r"\s?[-–]\s?",
    "dot": r"\.\s?",
    "loose_cnj": r"\d{1,7}@dash\d{2}@dot\d{4}@dot\d@dot\d{2}@dot\d{4}",
    "judged": r"(?:vistos|relatados)[^.]{0,60}?autos (?:de|do|des|dos) (?P<objeto>[\s\S]{0,300}?)(?:,| em que\b)",
    # what a description tells, read more strictly than it is found
    "told_year": r"\b(?:19|2[0O])[0-9OoIlSs]{2}\b",
    "told_title": r"(?:(?:exmo|exma)\.? (?:(?:sr|sra)\.? )?)?(?:ministro|ministra|min\.|desembargador|desembargadora|des\.)",
    "told_word": r"[A-ZÀ-Ý][\wÀ-ÿ'’]+",
    "told_name": r"(?-i:@told_word(?: (?:(?:d|da|de|do|das|des|dos|D|Da|De|Do|DA|DE|DO|Das|Des|Dos|DAS|DES|DOS|DaS|DeS|DoS|e) )?@told_word)*)",
    "told_rapporteur": r"(?:relatoria d\w{0,2}|(?:relatado|relatada) (?:pelo|pela)|\brel(?:ator|atora)?\.?|\b(?:do|da|pelo|pela)(?= @told_title))(?: @told_title){0,2} (@told_name)",
    # allusions
    "doctrine": r"‹jurisprudência|entendimento|entendimentos|orientação|orientações|posicionamento|precedentes|julgados|arestos|tese|súmula›",
    "case_law": r"(?:@doctrine|‹precedente|acórdão|julgado|verbete|enunciado›)",
    "praise": "‹" + _endings("pacífic", "consolidad", "reiterad", "sumulad", "firmad", "remansos", "iterativ", "majoritári", "uníson", "uniformizad", "assentad", "pacificad", "sedimentad", "tranquil", "maciç")
    + "|dominante|dominantes|predominante|sumular|sumulares|jurisprudencial|jurisprudenciais|assente|vinculante|vinculantes|recente|recentes|notória|notório|firme|firmes|uniforme|uniformes|aplicável|aplicáveis|pertinente|pertinentes›",
    "matter": r"‹espécie|caso|matéria|controvérsia|hipótese|tema|questão›",
    "to": r"‹à|ao|a|aos|às›",
    "binding": r"‹recurso repetitivo|recursos repetitivos|repercussão geral|incidente de assunção de competência|IRDR›",
    "complement": r"(?:‹de|do|da|dos|das|desta|deste|destes|destas|nesta|neste|no|na|nos|nas› @court|‹sobre› ‹a|o› @matter|@to @matter|‹em› ‹sede› @of @binding|‹em› ‹situações análogas|casos análogos|casos semelhantes|situações semelhantes›)",
    "jurisprudencia_generica": r"\b(?:@praise @case_law(?: @praise){0,2}(?: @complement){1,2}|@case_law(?: @praise){1,2}(?: @complement){1,2}|@doctrine @complement @complement)\b",
    "law_noun": r"‹norma|normas|legislação|dispositivo|dispositivos|preceito|preceitos|diploma|lei|artigo|art.|regra|regras|texto normativo|comando normativo›",
    "law_quality": "‹" + _endings("específic", "invocad", "violad", "mencionad", "apontad")
    + "|constitucional|constitucionais|legal|legais|infraconstitucional|infraconstitucionais|correspondente|aplicável|aplicáveis|pertinente|pertinentes|regente›",
    "law_complement": r"(?:‹de› ‹regência›(?: @of @matter)?|@of @law|@to @matter|‹na|no|nos› ‹origem|autos|recurso›|‹que› ‹disciplina|regula|rege|regulamenta|estabelece|dispõe|trata›(?: ‹sobre›)?(?: ‹a|o|as|os|da|do›)? [a-zà-ÿ]{4,}(?: ‹no|na› @matter)?)",
    "legislacao_generica": r"\b@law_noun(?: @law_quality){0,2} @law_complement\b",
}

#: pattern name, its kind, its rule; the order settles ties between spans
PATTERNS: list[tuple[str, str, str]] = [
    ("processo", "jurisprudencia", "processo"),
    ("sumula", "jurisprudencia", "sumula"),
    ("sumula", "jurisprudencia", "sumula_reversed"),
    ("tema", "jurisprudencia", "tema"),
    ("orientacao_jurisprudencial", "jurisprudencia", "orientacao"),
    ("numero_cnj", "jurisprudencia", "numero_cnj"),
    ("dispositivo_legal", "lei", "dispositivo_legal"),
    ("decisao_descritiva", "jurisprudencia", "decisao_descritiva"),
    ("jurisprudencia_generica", "jurisprudencia", "jurisprudencia_generica"),
    ("legislacao_generica", "lei", "legislacao_generica"),
]
GENERIC = {"jurisprudencia_generica", "legislacao_generica"}


@functools.cache
def expanded(rule: str) -> str:
    """A rule as a regular expression."""

    def part(m: re.Match[str]) -> str:
        if m["ref"]:
            return f"(?:{expanded(m['ref'])})"
        if m["words"]:
            return either(map(tolerant, m["words"].split("|")))
        return r"\s+" if m[0] == " " else r"\s*"

    return re.sub(r"@(?P<ref>[a-z_]+)|‹(?P<words>[^›]+)›| |~", part, RULES[rule])


@functools.cache
def compiled(rule: str, whole: bool = False) -> re.Pattern[str]:
    """The rule for Python's ``re``."""
    return re.compile(expanded(rule) + (r"\s*$" if whole else ""), re.IGNORECASE)


def for_spark(rule: str) -> str:
    """The rule for Spark's regular expressions: Unicode classes, any case, only \\n ends a line."""
    return "(?iudU)" + expanded(rule)


def selected(generic: bool = False) -> list[tuple[str, str, str]]:
    return [p for p in PATTERNS if generic or p[0] not in GENERIC]
