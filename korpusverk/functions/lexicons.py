"""Word lists of the Swedish marker families. Results depend on these exact lists."""

FUNCTION_WORDS = (
    "och eller men för så utan samt att som när om än fast fastän även trots varken både antingen efter innan medan eftersom ifall huruvida tills "
    "i på av med till om från under vid mot utom genom hos per sedan över inför bakom framför bredvid längs kring efter ut in upp "
    "den det de en ett sin sitt sina min mitt mina din ditt dina hans hennes deras vår vårt våra er ert era varje alla varandra några något någon ingen inget inga denna detta dessa "
    "jag du han hon vi ni de mig dig sig oss dem man vem vad vilket vilken vilka var hur "
    "är var vara har hade ha ska skall skulle kan kunde vill ville bör måste får fick bli blir blev blivit varit "
    "inte ej icke ju väl nog visst ja nej också redan bara ändå dock alltså därför nu då här där dit hit"
).split()

HEDGES_FORMAL = (
    "kanhända", "troligen", "sannolikt", "vanligen", "i allmänhet", "torde", "lär", "tycks", "cirka", "i viss mån", "i huvudsak", "delvis", "enligt min mening",
    "antyder", "så kallad", "så kallade", "påstådd", "påstådda", "förment", "uppges", "enligt uppgift", "med kopplingar till",
)
HEDGES_NEUTRAL = (
    "kanske", "möjligen", "möjligtvis", "eventuellt", "troligtvis", "förmodligen", "antagligen", "vanligtvis", "oftast", "sällan", "ibland", "nog", "ju", "kan", "kunde", "skulle kunna",
    "borde", "verkar", "tror", "tycker", "antar", "misstänker", "ungefär", "nästan", "på sätt och vis", "på något sätt", "i stort sett", "mer eller mindre", "så att säga", "en slags",
    "ett slags", "tyder på",
)
HEDGES_INFORMAL = ("väl", "liksom", "bara", "ba", "gissar", "runt", "lite", "ganska", "rätt", "typ", "enligt mig")
BOOSTERS = (
    "väldigt", "verkligen", "helt", "javligt", "jättebra", "fullständigt", "absolut", "definitivt", "enormt", "otroligt", "fantastiskt", "extremt", "verklig", "genuint", "uppenbarligen",
    "riktigt", "super", "mega", "jätte", "alldeles", "precis", "exakt", "oerhört", "obetydligt", "avsevärt",
)
NEGATIONS = ("inte", "ej", "icke", "aldrig", "ingenting", "ingenstans", "ingen", "inget", "inga", "varken", "knappast", "sällan", "näppeligen", "omöjligen")
EPISTEMIC = (
    "verkar", "tycks", "troligen", "förmodligen", "antagligen", "tydligen", "troligtvis", "förmodar", "misstänker", "anser", "tror", "menar", "tycker", "uppfattar", "upplever", "verka",
    "tycka", "tro", "mena", "anse", "uppfatta", "förefaller", "påstår", "hävdar", "framhåller",
)
PARTICLES = ("ju", "väl", "nog", "visst", "faktiskt", "egentligen", "nämligen", "alltså", "dock", "ändå", "trots", "tillochmed", "dessutom", "däremot", "emellertid", "likväl", "visserligen")

CATEGORIES = {
    "hedge": HEDGES_FORMAL + HEDGES_NEUTRAL + HEDGES_INFORMAL, "hedge_formal": HEDGES_FORMAL, "hedge_neutral": HEDGES_NEUTRAL, "hedge_informal": HEDGES_INFORMAL,
    "booster": BOOSTERS, "negation": NEGATIONS, "epistemic": EPISTEMIC, "discourse_particle": PARTICLES,
}
#: Spoken-language categories are left out of the formal register.
FORMAL_CATEGORIES = tuple(k for k in CATEGORIES if k not in ("booster", "discourse_particle"))
#: Parts of speech in which an ambiguous single word counts as a hedge.
HEDGE_POS = {"rätt": ("ADV",), "runt": ("ADV", "ADP"), "kan": ("AUX", "VERB"), "kunde": ("AUX", "VERB"), "borde": ("AUX", "VERB"), "torde": ("AUX", "VERB"), "lär": ("AUX", "VERB")}
SUBORDINATE = ("advcl", "relcl", "acl", "acl:relcl", "csubj", "csubj:pass", "ccomp")
MONTHS = {m: i for i, m in enumerate(("jan", "feb", "mar", "apr", "maj", "jun", "jul", "aug", "sep", "okt", "nov", "dec"), 1)}
