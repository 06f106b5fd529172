"""Problem 6: defective prompt and response pairs, by ordered rules on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.ordered import made_once

# What stands in for an answer.
STAND_INS = ("n/a", "na", "null", "none", "nil", "nan", "no_match", "no match", "no answer", "tbd", "todo", "undefined", "not available", "keine antwort", "sin respuesta", "sem resposta", "pas de réponse", "कोई जवाब नहीं")
# How an answer is declined, by language; a sentence that begins so is a refusal.
REFUSALS = (
    r"i['’]?m sorry,? but i (?:can|am not|cannot)", r"(?:sorry,? )?i (?:can['’]?t|cannot|can not|am unable to|am not able to|will not|won['’]?t) (?:help|assist|provide|answer|discuss|share|give|comment)", r"as an? (?:ai|assistant|language model)\b",
    r"(?:unfortunately,? )?i (?:must|have to) (?:decline|refuse)", r"(?:that|this) is (?:outside|beyond) what i", r"i (?:don['’]?t|do not) feel comfortable", r"i['’]?m not (?:able|allowed|permitted) to",
    r"es tut mir leid,? (?:aber |dabei |da |ich )", r"(?:zu|über) dies\w+ \w+ darf ich", r"dies\w+ \w+ muss ich (?:leider )?ablehnen", r"(?:leider )?(?:kann|darf) ich (?:dabei|dazu|das|ihnen|diese)\b.*\bnicht", r"ich (?:kann|darf) (?:dabei|dazu|diese frage) .*nicht",
    r"(?:je suis désolé,? )?(?:mais )?je (?:ne peux|ne suis) pas", r"je dois (?:malheureusement )?refuser", r"il ne m['’]est pas permis", r"en tant qu['’](?:assistant|ia)",
    r"lo siento,? (?:pero )?no puedo", r"no (?:estoy autorizad|me está permitid|puedo (?:ayudar|responder|dar))", r"tengo que rechazar", r"como asistente",
    r"(?:desculpe|lamento|sinto muito),? (?:mas )?não posso", r"não (?:estou autorizad|posso (?:ajudar|responder))", r"tenho (?:de|que) recusar", r"como assistente",
    r"माफ़ कीजिए,? (?:मैं|लेकिन)", r"मुझे इस विषय पर", r"मैं इस (?:सवाल|विषय|अनुरोध).*(?:नहीं|अस्वीकार)", r"क्षमा करें,? मैं",
)
# The articles, pronouns, prepositions, conjunctions, auxiliaries and question words of each language; of Hindi in both scripts.
FUNCTION_WORDS = {
    "en": "the a an and or but if of to in on at by for with from as into about after before under over than then so not no nor is are was were be been being am do does did have has had will would can could shall should may might must i you he she it we they me him her us them my your his its our their this that these those what which who whom when where why how all any each few more most other some such only own same too very there here yes please up down out",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber wenn als wie zu in im an am auf für mit von vom bei nach aus über unter vor zwischen durch ohne gegen um nicht kein keine keinen ist sind war waren sein bin bist wird werden wurde würde hat haben habe hatte kann können soll sollen muss müssen darf ich du er sie es wir ihr mich mir dich dir ihm ihn uns mein meine meinen meiner meines meinem dein ihre ihrer ihren unser dieser diese dieses was wer wo wann warum welche welcher welches alle mehr sehr nur noch schon auch so da dann hier ja nein bitte zum zur bis seit",
    "fr": "le la les l un une des du de d et ou mais si que qui quoi dont où quand comment pourquoi quel quelle quels quelles à au aux en dans sur sous avec sans pour par entre vers chez après avant depuis pendant ne pas plus non oui est sont était être suis es êtes a ont avez avons ai avait aura peut peux pouvez doit dois faut fait je tu il elle on nous vous ils elles me te se lui leur mon ma mes ton ta tes son sa ses notre nos votre vos ce cet cette ces tout tous toute toutes même aussi très bien y c n s j qu m combien",
    "es": "el la los las un una unos unas de del al y e o u pero si que qué quien quién cual cuál cuando cuándo donde dónde como cómo por para con sin sobre entre hasta desde en a no ni sí más menos muy ya es son era ser está están estoy estaba fue ha han he hay tiene tengo puede puedo pueden debe yo tú él ella usted nosotros ellos ustedes me te se le les lo nos mi mis tu tus su sus este esta estos estas ese esa eso todo toda todos cada también porque cuánto cuánta",
    "pt": "o a os as um uma uns umas de do da dos das no na nos nas ao aos à às e ou mas se que quê quem qual quais quando onde como por para com sem sobre entre até desde em não nem sim mais menos muito já é são era ser está estão estou estava foi tem têm tenho há pode posso podem deve eu tu ele ela você nós eles vocês me te lhe meu minha meus minhas seu sua seus suas este esta esse essa isso isto todo toda todos cada também porque pelo pela quanto quanta",
    "hi": "में का की के को से क्या मैं आप नहीं और यह पर है हैं हो हाँ इस ही तक था थे थी लिए कर ने जो कोई हर मेरा मेरी मेरे अपना कब कहाँ कैसे क्यों कितना कौन वह hai hain hoon tha thi ka ki ke ko mein aur ya agar nahin nahi kya kab kahan kaise kyon kitna kitni kaun jo yeh ye woh wo un mera meri mere aap aapka aapki aapke hum humein mujhe unka unki kar karna karte karta raha rahi liye bhi hi tak sakta sakte sakti hota hoti gaya gayi",
}
ORDER = ("empty", "copy", "refusal", "truncated", "wrong_language")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{Nd}]+", " "), " "), lambda w: w != "")


def is_empty(answer: Column) -> Column:
    """Null, blank, without a letter or digit, a known stand-in, or nothing but a bracketed slot."""
    bare = F.regexp_replace(F.lower(answer), r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$", "")
    return answer.isNull() | (bare == "") | bare.isin(*STAND_INS) | answer.rlike(r"^\s*[\[<{(][\p{Lu}_ ]+:?[\]>})]\s*$")


def is_truncated(answer: Column) -> Column:
    """An opened bracket, quote or fence stays open, or the text ends without the mark that ends a sentence."""
    end = F.regexp_replace(answer, r"\s+$", "")
    opened = lambda a, b: F.regexp_count(answer, F.lit(a)) > F.regexp_count(answer, F.lit(b))
    delimiters = opened(r"\(", r"\)") | opened(r"\[", r"\]") | opened("“", "”") | opened("«", "»") | (F.regexp_count(answer, F.lit("```")) % 2 == 1)
    return delimiters | ~end.rlike(r"[.!?।॥…][\"'”»)\]*]*$|[)\]]$|```$|[\"”»]$")


def is_refusal(answer: Column) -> Column:
    """A sentence, or what follows a heading word, begins with a phrase of refusal."""
    return F.lower(answer).rlike(r"(?:^|[.!?।:]\s+)[\s\"'“¡*_>-]*(?:" + "|".join(REFUSALS) + ")")


def is_copy(q: Column, a: Column) -> Column:
    """The answer says hardly more than the question: most words of the one are words of the other, whatever case, quotes or heading were added, and it is at most three times as long. q and a are their words."""
    own = F.array_distinct(q)
    kept = F.size(F.array_intersect(own, a))
    new = F.size(F.array_except(a, q))
    return (F.size(q) > 0) & (F.size(a) > 0) & (F.size(a) <= 3 * F.size(q) + 4) & (new <= F.greatest(F.lit(1), F.floor(F.size(F.array_distinct(a)) * 0.22))) & (kept >= 0.7 * F.size(own))


# Letters and marks that few languages write.
LETTERS = {"de": "[äöüß]", "fr": "[èêëîïôûœçà]", "es": "[¿¡ñ]", "pt": "[ãõ]"}


def votes(words: Column, text: Column) -> Column:
    """How many function words and letters of each language a text with these words has: array<struct<n, lang>>. A text mostly in Devanagari speaks for Hindi alone."""
    words, low = F.array_distinct(words), F.lower(text)
    of = lambda lang, known: F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in sorted(set(known.split()))]))) + (F.when(low.rlike(LETTERS[lang]), 1).otherwise(0) if lang in LETTERS else 0)
    counted = F.array(*[F.struct(of(lang, known).alias("n"), F.lit(lang).alias("lang")) for lang, known in FUNCTION_WORDS.items()])
    return F.when(F.regexp_count(text, F.lit(r"[\x{0900}-\x{097F}]")) * 3 > F.length(text), F.array(F.struct(F.lit(1).alias("n"), F.lit("hi").alias("lang")))).otherwise(counted)


def loudest(ordered: Column) -> Column:
    """The languages with the most votes, of votes in descending order; several on a tie, none where nothing speaks."""
    return F.transform(F.filter(ordered, lambda s: (s["n"] > 0) & (s["n"] == F.get(ordered, 0)["n"])), lambda s: s["lang"])


def with_defects(states: DataFrame, question: str = "question", answer: str = "answer", route: str = "route") -> DataFrame:
    """Adds defects, every triggered type in the order of the rules: empty, copy, refusal, truncated, wrong_language.

    Only rows of the route rag_answer are judged; others, and those of a null route, get an empty array. A null question can be neither copied nor of another language.
    Answers of any length are read whole. No row is shuffled; words, languages and defects are made once a row, and for judged rows only.
    """
    a = F.col(answer)
    text, asked = F.coalesce(a, F.lit("")), F.coalesce(F.col(question), F.lit(""))
    judged = F.coalesce(F.col(route) == "rag_answer", F.lit(False))
    worded = made_once(states, __qw=F.when(judged, _words(asked)), __aw=F.when(judged, _words(text)))
    voted = made_once(worded, __qv=F.when(judged, F.sort_array(votes(F.col("__qw"), asked), asc=False)), __av=F.when(judged, F.sort_array(votes(F.col("__aw"), text), asc=False)))
    spoken = made_once(voted, __ql=loudest(F.col("__qv")), __al=loudest(F.col("__av")))
    tests = {
        "copy": is_copy(F.col("__qw"), F.col("__aw")),
        "refusal": is_refusal(text),
        "truncated": is_truncated(text),
        "wrong_language": (F.size("__ql") > 0) & (F.size("__al") > 0) & ~F.arrays_overlap("__ql", "__al"),
    }
    found = F.when(is_empty(a), F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(*[F.when(F.coalesce(tests[k], F.lit(False)), F.lit(k)) for k in ORDER[1:]])))
    return made_once(spoken, defects=F.when(judged, found).otherwise(F.array().cast("array<string>"))).drop("__qw", "__aw", "__qv", "__av", "__ql", "__al")


def found(states: DataFrame) -> DataFrame:
    """(state_id, defect): the first defect of each defective row."""
    judged = states.where(F.col("route") == "rag_answer").select("state_id", "question", "answer", "route")
    return with_defects(judged).where(F.size("defects") > 0).select("state_id", F.element_at("defects", 1).alias("defect"))
