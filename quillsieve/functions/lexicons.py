"""Word lists, patterns and messages that fix the results of the text rules."""

from __future__ import annotations

import unicodedata

# ---- Fixed values: regular expressions -------------------------------------------------
LETTER = r"[\p{L}\p{Nl}\p{No}]"
ALNUM = r"[\p{L}\p{N}]"
WORD = rf"{LETTER}+(?:['’-]{LETTER}+)*"
#: A text cut into words and what stands between them.
WORD_OR_GAP = rf"{WORD}|[^\p{{L}}\p{{Nl}}\p{{No}}]+"
#: The same for the JVM, which recurses once for each repetition of a group unless the repetition is possessive; nothing follows it, so the matches are the same.
JVM_WORD = WORD + "+"
JVM_WORD_OR_GAP = rf"{JVM_WORD}|[^\p{{L}}\p{{Nl}}\p{{No}}]+"
TIMESTAMPS = (
    r"\[(?:\d{1,2}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?\]",
    r"\((?:\d{1,2}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?\)",
    r"\b(?:\d{1,2}:)?\d{2}:\d{2}[.,]\d{1,3}\b",
    r"\b(?:\d{1,2}:)?\d{1,2}:\d{2}\b",
)
VOWELS = r"[aeiouyáàâãéêíóôõúüAEIOUYÁÀÂÃÉÊÍÓÔÕÚÜ]+"

# ---- Fixed values: hesitations by language ---------------------------------------------
FILLERS = {
    "en": ["uh", "um", "uhm", "uhh", "umm", "ah", "ahh", "er", "erm", "hmm", "hm", "huh", "mhm", "mm", "uh-huh", "uhhuh"],
    "pt": ["ah", "eh", "né", "ne", "hm", "hmm", "ãh", "ahn", "uhn", "hum", "éh", "hã", "hãã"],
    "es": ["eh", "ehh", "hmm", "hm", "eee", "mmm"],
    "fr": ["euh", "heu", "hmm", "hm", "euhm", "bah"],
    "de": ["äh", "ähm", "hmm", "hm", "ähh", "öh"],
}

# ---- Fixed values: sound and action notes, accents folded ------------------------------
NONVERBAL_STEMS = """
suspir risad rindo riso laugh music paus silenc toss pigarr espirr gaguej inaud incompreens aplaus applau cheer
scream instrument sigh cough sneez stutter unintell gasp chuckl breath soupir rire toux eternu begai seufz husten
niesen stotter unversta estornud tartamud llant grito trilha barulh ruid bocej gemid assov enfase choro palma
lachen lacht gelacht
""".split()
NONVERBAL_EXACT = "tos tose toser tosiendo sing sings singing sang sung canto cantar cantando".split()
STAGE_MODIFIERS = """
alto alta altos altas baixo baixa longo longa curto curta nervosa nervoso nervosamente tocando de do da dos das
fundo plateia e ou com um uma o a high low long short loud loudly soft softly nervous nervously playing of the
background audience and largo larga bajo del y fort forte longue bas basse nerveusement du fond et laut leise lang
lange nervos von und hintergrund
""".split()

# ---- Fixed values: messages ------------------------------------------------------------
RATE_LIMITED = "O YouTube limitou o acesso às legendas. O processamento foi cancelado."
CANCELLED = "Processamento cancelado porque o YouTube limitou o acesso às legendas."
RATE_LIMIT_MARKS = ("limitou o acesso às legendas", "limitou temporariamente o acesso às legendas")
BLOCK_MARKS = ("ipblocked", "requestblocked", "blocking requests from your ip")
CAPTION_MESSAGES = {
    "no_transcript": "Este vídeo não possui legendas disponíveis.",
    "video_unavailable": "Este vídeo não está disponível.",
    "invalid_video_id": "Identificador de vídeo inválido.",
    "invalid_url": "Identificador de vídeo inválido.",
}
CAPTION_FAILED = "Falha ao obter a legenda deste vídeo."
NOT_AN_ERROR = "Só é possível tentar novamente uma transcrição com erro."
STILL_PROCESSING = "A playlist ainda está em processamento."
NOTHING_TO_RETRY = "Nenhum vídeo pendente para tentar novamente."
FAILED_SUFFIX = " vídeos não puderam ser transcritos"
CRITERIA = ("coherence", "richness", "factuality")


def accent_folds() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the letters that stay when the marks are taken off; by Unicode decomposition."""
    marked, plain = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if base != char and len(base) == 1:
            marked.append(char)
            plain.append(base)
    return "".join(marked), "".join(plain)


def single_capitals() -> tuple[str, str]:
    """Letters whose upper case is several characters, and the one character that stands for it: the title form, else the letter itself; ẞ for ß."""
    wide = [chr(c) for c in range(0x10000) if len(chr(c).upper()) > 1]
    return "".join(wide), "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in wide)
