"""Filler stripping of model replies and of prompts. Line rules with a fence state: pandas UDFs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whole lines of a reply that are filler (lower case, without a mark at the end).
REPLY_LINES = frozenset("""certainly|sure|sure thing|absolutely|of course|no problem|you're welcome|you are welcome|happy to help
glad to help|my pleasure|thanks|thank you|thanks for asking|great question|good question|here you go|hope this helps
let me know if you|let me know if|let me know what|let me know|feel free to ask|please don't hesitate|don't hesitate
don't hesitate to ask|best regards|regards|happy coding|good luck|let's get started|lets get started|here's how|here is how
here's what you|here is what you|in summary|in conclusion|bottom line|i hope|i hope this|enjoy|you got it|you bet|no worries
all good|got it|right|exactly|nice|well done|great job|cheers|thanks again|thanks so much|thank you so much
have a great day|have a nice day|take care|goodbye|bye|see you""".replace("\n", "|").split("|"))
# Starts of a reply's lines that are filler.
REPLY_STARTS = tuple("""let me know if|let me know what|feel free to|please don't hesitate|don't hesitate|i think|i believe|i feel
i'm not sure|i am not sure|in my opinion|as far as i|it seems|it appears|seems like|note that|please note|it's worth noting
it is worth noting|it's important to note|it is important to note|one thing to note|as a reminder|just to be clear|to be clear
in other words|in short|long story short|to summarize|to sum up|in a nutshell|at the end of the day|needless to say|obviously
of course,|certainly,|interestingly|unfortunately,|luckily|hopefully|anyway,|anyhow,|regardless,|as i said|as mentioned
as i mentioned|again,|additionally,|moreover,|furthermore,|also, remember|remember,|keep in mind|please remember
it goes without saying|no offense|with that said|that said,|having said that|on a side note|by the way|btw,|fyi,|for reference
for your reference|for context,|just a heads up|quick note|quick tip|pro tip|one more thing|last but not least
first and foremost|i hope this helps|hope that helps|hope it helps|happy to clarify|happy to elaborate|let me elaborate
let me explain|let me walk you|let me break it down|the short answer is|the short version is|the long and short|bottom line:""".replace("\n", "|").split("|"))
# Whole lines of a prompt that are filler.
PROMPT_LINES = frozenset("""thanks|thank you|thanks a lot|thanks so much|thank you very much|thank you so much|thanks in advance
thank you in advance|tia|thanks again|thanks for reading|thanks for your time|thanks for your help|thank you for your help
thanks for the help|appreciate it|i appreciate your help|i really appreciate it|i'd really appreciate it
i would really appreciate it|any help would be appreciated|any help is appreciated|please help|please help me
please help me out|help me please|i need help|i need your help|can you help me|could you help me|can you help me out
could you help me out|would you be able to help|sorry|sorry for the long message|sorry for the wall of text
sorry for being so verbose|apologies for the long message|apologies for the verbosity|i apologize for the long message|great
awesome|perfect|excellent|nice|sounds good|ok|okay|got it|understood|noted|cheers|regards|best|best regards
have a great day|have a nice day|take care""".replace("\n", "|").split("|"))
# Starts of a prompt's lines that are filler.
PROMPT_STARTS = tuple("""hello|hi |hi,|hey |hey,|good morning|good afternoon|good evening|i hope you|i hope this|hope you|hope this
i was wondering|i was just wondering|wondering if you|i would like to ask|i have a question|i have a quick question
quick question|just a quick question|so basically,|i've been stuck|i have been stuck|i've been trying|i am stuck|i'm stuck
i'm getting frustrated|i am getting frustrated|i'm pretty frustrated|i am pretty frustrated|i'm honestly stuck
please take a look|can you take a look|could you take a look|please look into|can you look into|could you look into
let me give you|let me provide|let me explain|let me walk you|let me break it down|just to give you|for context,
to be honest|honestly,|sorry for|apologies for|thanks in advance|thanks so much|thanks again|thank you for your time
hoping you can help|hoping you can|i'm hoping you|i am hoping you|i really hope you|any help you can provide
if it's not too much trouble|i don't want to bother you|sorry to bother you|sorry to bug you|this may be a silly question
this might be a dumb question|i might be wrong but|correct me if i'm wrong""".replace("\n", "|").split("|"))
# Phrases that are cut out of a reply's sentences, in order of trial.
INLINE = tuple("""well, |well |so, |so |i think that, |i think that |i think, |i think |you know, |you know |basically just |basically, |basically
i mean, |i mean |sort of |kind of |to be honest, |honestly, |honestly |for what it's worth, |for what its worth, |at the end of the day, |
i believe that, |i believe that |i believe, |i believe |it seems like, |it seems like |it seems that, |it seems that |it appears that, |it appears that |
as you can see, |as you know, |needless to say, |obviously, |obviously |of course, |of course |certainly, |certainly |hopefully, |hopefully |
fortunately, |fortunately |unfortunately, |unfortunately |interestingly, |interestingly |naturally, |naturally |clearly, |clearly |indeed, |indeed |just |really |very """.replace("basically\n", "basically |").replace("\n", "").split("|"))
# Words of which short lines of small talk consist, and those that are one alone.
SMALL = frozenset("""sure certainly absolutely definitely great good question answer of course no problem thanks thank you you're welcome
happy glad help hope this helps yes ok okay right nice cool awesome perfect exactly correct done got it understood noted enjoy
bye cheers regards best hello hi hey there anytime gotcha yep yeah yup thx indeed agreed excellent wonderful interesting
lovely splendid re well at the a an in on for and with really very much me my your our just now then here so too also
please take look advance asking tell give know let want wanted say ask could would should can will have has had am is are
was were be been being to i i'm i've i'd we we're about from that these those some any more helping code""".split())
ALONE = frozenset("""sure certainly absolutely definitely great good yes yeah yep yup ok okay right nice cool awesome perfect exactly
correct done got it understood noted cheers regards hello hi hey anytime gotcha thx thanks thank bye indeed agreed excellent
wonderful interesting lovely splendid there""".split())


def payload(line: str) -> bool:
    """Whether a trimmed line holds more than prose: code, paths, items, or over 120 bytes."""
    if any(c in line for c in ":=()/\\#[]{}<>&$") or "file" in line:
        return True
    bare = line.lstrip(" \t-*•0123456789.")
    return (bare != "" and bare != line) or len(line.encode()) > 120


def small_talk(line: str) -> bool:
    """Up to six filler words, or one that is an acknowledgement."""
    for mark in ',!?."':
        line = line.replace(mark, " ")
    words = [w.strip("'-") for w in line.split(" ") if w]
    if len(words) == 1:
        return words[0] in ALONE
    return 0 < len(words) <= 6 and all(w in SMALL for w in words)


def filler(line: str, lines: frozenset[str], starts: tuple[str, ...]) -> bool:
    if payload(line):
        return False
    low = line.lower().rstrip(" .!?")
    return low in lines or low.startswith(starts) or small_talk(low)


def without_phrases(line: str) -> str:
    """The sentence without filler phrases at its start, after commas and after full stops."""
    out = line
    while True:
        phrase = next((p for p in INLINE if out.lower().startswith(p)), None)
        if phrase is None:
            break
        out = out[len(phrase) :]
    for joint in (", ", ". "):
        for phrase in INLINE:
            at = out.lower().find(joint + phrase)
            while at >= 0:
                out = out[:at] + joint + out[at + len(joint) + len(phrase) :]
                at = out.lower().find(joint + phrase)
    if out == line:
        return line
    out = out.strip().removeprefix(", ").removeprefix(",")
    while ", , " in out:
        out = out.replace(", , ", ", ")
    while ",," in out:
        out = out.replace(",,", ",")
    return out[0].upper() + out[1:] if out[:1].isascii() and out[:1].islower() else out


def stripped(text: str, lines: frozenset[str], starts: tuple[str, ...], phrases: bool) -> tuple[str, int]:
    """(text, dropped lines): fenced code stays as it is, runs of blank lines become one."""
    out, dropped, fenced = [], 0, False
    for raw in text.split("\n"):
        bare = raw.strip()
        if bare.startswith(("```", "~~~")):
            fenced = not fenced
            out.append(raw)
        elif fenced:
            out.append(raw)
        elif not bare:
            if out and out[-1].strip():
                out.append("")
        elif filler(bare, lines, starts):
            dropped += 1
        else:
            indent = raw[: len(raw.rstrip()) - len(bare)]
            out.append(indent + (bare if not phrases or payload(bare) else without_phrases(bare)))
    joined: list[str] = []
    for line in out:  # lines that became blank
        if line.strip() or (joined and joined[-1].strip()):
            joined.append(line)
    while joined and not joined[-1].strip():
        joined.pop()
    return "\n".join(joined), dropped


def strip_reply(text: str) -> tuple[str, int]:
    return stripped(text, REPLY_LINES, REPLY_STARTS, True)


def strip_prompt(text: str) -> tuple[str, int]:
    """Narrower rules for prompts, which never become empty."""
    out, dropped = stripped(text, PROMPT_LINES, PROMPT_STARTS, False)
    return (text, 0) if dropped and not out.strip() else (out, dropped)


def compress_prompt_text(text: str) -> str:
    """Lines trimmed, blank runs to one, equal neighbours to one, then prompt filler out."""
    out: list[str] = []
    for line in (x.strip() for x in text.split("\n")):
        if line or (out and out[-1]):
            out.append(line)
    while out and not out[-1]:
        out.pop()
    once = [x for k, x in enumerate(out) if not k or x != out[k - 1]]
    return strip_prompt("\n".join(once))[0]


COUNTED = T.StructType().add("text", T.StringType()).add("dropped", T.LongType())


@F.pandas_udf(COUNTED)
def terse_reply(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([strip_reply(t or "") for t in texts], columns=["text", "dropped"])


@F.pandas_udf(COUNTED)
def terse_prompt(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([strip_prompt(t or "") for t in texts], columns=["text", "dropped"])


@F.pandas_udf(T.StringType())
def compress_prompt(texts: pd.Series) -> pd.Series:
    return texts.fillna("").map(compress_prompt_text)
