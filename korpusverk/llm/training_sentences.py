"""Labelled documents from which the model of personal information is trained: frames written for this purpose, filled with invented people, numbers and
streets by a seeded generator. [kind text] marks what is to be found."""

from __future__ import annotations

import random

#: Frames with personal information. G: given name, F: surname, K: initial, P: phone, S: phone in words, I: identity number, A: street with number, E: mailbox.
WITH = """
Läraren presenterade sig som [name G F] på mötet
kontaktperson är [name G F]
hon kallar sig [name G] här
min kusin heter [name G] och bor utomlands
Grannen heter [name G F] tror jag
Chefen heter [name F, G] enligt listan
Vi pratade med [name G F] på banken
Prata med [name G] innan du bestämmer dig
Läkaren [name G F] skrev ut något annat
Handläggaren [name G F] återkom aldrig
Handläggaren [name F, G] återkom aldrig
Handläggaren [name G K. F] återkom aldrig
[name G K. F] lärde mig det mesta
[name G K. F] tipsade om boken
Jag åkte dit med [name G] en gång
Tala med [name G] först
Prata med [name G F] om saken
Hon heter [name F, G] i registret
Ägaren heter [name F, G] och svarar aldrig
Enligt [name G F] går det bra ändå
Enligt [name F, G] går det bra ändå
[name G F] rekommenderade en annan butik
[name G] sa precis detsamma
[name G F] gav mig det rådet
[name F, G] gav mig det rådet
Det var [name G] som ordnade biljetterna
det är [name G] som kan sådant
[name Gs] syster har en likadan
[name Gs] mamma blev arg
Jag lånade [name Gs] bil i helgen
Hälsningar [name G]
Hälsningar\n[name G F]
Mvh [name G F]
Mvh\n[name G]
Med vänlig hälsning\n[name G F]
// [name G]
/[name G]
Tack igen! /[name G]
Det var allt för mig. //[name G]
[name G F]\n[phone P]\n[email E]
[name G F]\n[phone S]\n[email E]
[name G F], [address A], 123 45 Ortby
Leverans till [name G F], [address A], 563 21 Nystad tack
Uppgifterna var: [name F G], [id_number I], [address A], 811 11 Vikby
Uppgifterna var: [name G F], [id_number I], [address A]
[phone P] är numret dit
Mobil: [phone P]
tfn [phone P]
Telefonnummer [phone P] kvällstid
Ring oss på [phone P] så ordnar det sig
Du får gärna ringa [phone P] när som helst
Hon svarar på [phone P] efter fem
Jag har nummer [phone P] sedan länge
Slå [phone P] och fråga efter chefen
Skicka sms till [phone P]
nås på [phone P]
Ring mig på [phone S]
Numret är [phone S] om du undrar
Växeln har [phone S] som nummer
Mitt personnummer är [id_number I]
personnummer [id_number I]
Pnr: [id_number I]
Jag uppgav [id_number I] men det godtogs inte
I journalen stod det [id_number I] överst
Han är registrerad som [id_number I]
Samordningsnummer [id_number I] gäller tills vidare
På kortet står [id_number I] med små siffror
Kunden med [id_number I] ringde igen
Vi flyttade till [address A] förra året
Huset på [address A] är till salu
Hon bor på [address A] nu
adressen är [address A]
adress: [address A]
Festen är på [address A] klockan sju
Grannarna på [address A] klagar alltid
Skicka brevet till [address A].
Kom förbi [address A] någon kväll
Han växte upp på [address A] med sin bror
Mejla [email E] så hör jag av mig
e-post: [email E]
Skriv några rader till [email E] först
Min mejl är [email E]
([email E])
Frågor besvaras på [email E] varje vardag
[email E] fungerar bäst
Jag fyllde i [id_number I] på blanketten
Det gäller [id_number I] och ingen annan
först angav jag [id_number I] sedan inget mer
[id_number I]
Systemet visade [id_number I] i rutan men godkände det inte
De frågade efter [id_number I] i kassan
[phone P]
Det finns ett gammalt [phone P] också
Hej!\n[phone P]\nkvällar
Fick [phone P] av en vän
Hon flyttade från [address A] i våras
Det hände på [address A] en natt
[address A] är min förra adress
Källaren på [address A] är fuktig
[address A]\n12345 VIKBY
Butiken låg på [address A] förr
Rummet på [address A]\n98765 Nystad är ledigt
""".strip().split("\n")
#: Frames without. N: amounts, dates, orders and the like; W: a street without a house number; D: an everyday word that is also a name; T: a town; F: a surname.
WITHOUT = """
Det kostade N i slutändan
Saldot var N i går, jättekonstigt
Det stod N på räkningen
Vi träffades den N och pratade
Ordernummer N syns inte i systemet
Artikelnumret N hittar jag inte
Kundnummer N behövs vid köp
Ärendet N är stängt
Ärendenummer N
Fakturan N är betald
Bolaget har organisationsnummer N i registret
Orgnr N
Version N löste problemet
Jag gick W fram i regnet
På W finns inga affärer kvar
Kvarteret vid W är fint
Vi såg en D i går
Det är en D som ligger där
Har du en D hemma?
Det blev en lång D till slut
D är inget att vara rädd för
D och annat finns på hyllan
D kan vara ett bra val
en liten D
den där D
i D åker vi bort
till D blir det bättre
alla D är slut
D finns överallt här
D passar bra ihop med annat
man bygger med D där
man kan D det utan hjälp
jag ska D den själv i år
svårt att D det nu
vi skulle D oss till slut
den kan nog D mer än så
prata med någon annan först
Jag bor i T sedan länge
Tåget till T var försenat
Alla i T vet det
Folk från T brukar säga så
@Gs skrev likadant
@G_82 har rätt
@snällfix77 förklarade det bättre
Handläggaren svarade inte alls
Min syster har samma problem
Grannen ringde polisen
Hälsningar från landet
Mvh
Prata med någon som kan
Enligt kommunen är det lagligt
Hon heter något helt annat
Chefen är ny här
Buss 14 går till hus 3 och sedan väg 22 mot stan
Jag planerade i förväg 25 gånger
Vi cyklade hela vägen 30 minuter
Det är på väg 9 personer hit
Det ligger längs väg 44 någonstans
Köpte 6 st @ 30 kr styck
Rum 12 och plan 4 var låsta
Det beror på mig. 14 dagar gick
Kapitel 3 sidan 112 handlar om det
Tack för svaret Edit: det löste sig
Och Sedan Kom Dom Hem
Volvo och Ikea är dyra
Jag har en bror per sida
Vara,Pris,Antal,Betyg\nkaffe,N,N
Namn, Ort, Land
Namn;Ort;Pris
Vi hade Volvo, Saab och Ikea på listan
Sverige, Norge och Danmark är med
Prova Linux, Windows eller Android
Hos Ikea, Elgiganten finns det
Vara\tPris\tAntal
Jag skrev N i rutan
Det var N på mätaren
Ring inte, skriv i stället
Jag bor på landet och har 14 höns
Vi bodde i W förut
Det är tyst på W om natten
På sida 12 i boken
De åt på Stadshotellet, Hamnkrogen och Gästis
""".strip().split("\n")
#: Frames in which a name comes up again without any sign of its own.
AGAIN = """
[name G] kom sen
Då blev [name G] glad
Men [name G] visste inget
vi såg [name G] igen
Och [name G] höll med
sedan kom [name Gs] bror
Sen for [name G] hem
""".strip().split("\n")

STEMS = "kvarnsten snickar smeds skol kyrk björk ring park hamn slotts kungs linné ek tall bruks mejeri sjö kvarn lång storm norr söder berg".split()
ENDS = "gatan vägen väg stigen gränd gränden backen allén allé torget".split()
TOWNS = "Vikby Nystad Ortby Strandköping Lundhamn Östvalla".split()
#: Given names that are everyday words too.
PLAIN = "björn sten saga linnea siv stig bo maj vera lova tove rune klara mona per hans".split()
FAMILY = "Sand Berg Lund Alm Ny Ek Stor Hög Fors Dal Sjö Vik".split()
FAMILY_ENDS = "berg ström lund gren qvist man mark dahl holm sson hielm ell rud vik mo sten".split()
#: Given names that no list holds, for learning what stands around a name.
RARE = "Tuulikki Algot Aurora Ingeborg Zlatko Wilmer Torgny Hedvig Noomi Ossian".split()
DIGITS = "noll ett två tre fyra fem sex sju åtta nio".split()


def check_digit(nine: str) -> str:
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(nine))
    return str(-total % 10)


def phone(r: random.Random) -> str:
    lead = r.choice(("070", "073", "076", "08", "08", "031", "040", "0520", "0611", "0980"))
    rest = "".join(r.choice("0123456789") for _ in range(r.choice((6, 7, 7, 8)) if len(lead) < 3 else 7 if len(lead) < 4 else 6))
    form = r.randrange(10)
    pairs = f"{rest[:-4]} {rest[-4:-2]} {rest[-2:]}"
    if form in (0, 9):
        return lead + rest
    if form < 4:
        return f"{lead}-{pairs}" if form < 3 else f"{lead} {pairs}"
    if form == 4:
        return f"+46 {lead[1:]} {pairs}" if r.random() < 0.5 else f"+46{lead[1:]}{rest}"
    if form == 5:
        return f"0046{lead[1:]}{rest}"
    if form == 6:
        return f"+46 (0){lead[1:]}-{rest}"
    return f"{lead}/{pairs}" if form == 7 else f"{lead}.{pairs.replace(' ', '.')}"


def identity(r: random.Random) -> str:
    year, month, day = r.randrange(30, 99), r.randrange(1, 13), r.randrange(1, 29) + (60 if r.random() < 0.15 else 0)
    nine = f"{year:02d}{month:02d}{day:02d}{r.randrange(1000):03d}"
    head, tail = nine[:6], nine[6:] + check_digit(nine)
    return r.choice(("", "19")) + head + r.choice(("-", "-", "", " ")) + tail


def address(r: random.Random) -> str:
    stem, number = r.choice(STEMS), str(r.randrange(1, r.choice((10, 100, 140))))
    street = r.choice((stem + r.choice(ENDS), stem + r.choice(ENDS), stem + r.choice("gv") + ".")).capitalize()
    if r.random() < 0.15:
        street = r.choice(TOWNS)[:-2] + " " + r.choice(ENDS[:2])
    elif r.random() < 0.45:
        street = r.choice("Norra Södra Östra Västra Gamla Stora Lilla".split()) + " " + street
    return f"{street} {r.choice(('', '', '', 'nr '))}{number}{r.choice(('', '', '', ' B', 'c', ' a'))}"


def mailbox(r: random.Random, given: str) -> str:
    local = (given.lower() + r.choice(("", "." + r.choice(FAMILY).lower(), str(r.randrange(99))))) if r.random() < 0.6 else r.choice(("info", "katten", "snabbsvar")) + str(r.randrange(99))
    at, dot = r.choice((("@", "."), ("@", "."), (" @ ", "."), ("[at]", "[dot]"), (" snabel-a ", " punkt "), ("(at)", ".")))
    return f"{local}{at}{r.choice(('brevlada', 'postvagn', 'mejlhus'))}{dot}{r.choice(('example', 'test', 'invalid'))}"


def number(r: random.Random, frame: str) -> str:
    n = lambda k: "".join(r.choice("123456789") for _ in range(k))
    if "den N" in frame:
        return f"20{r.randrange(10, 24)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}" + r.choice(("", f" kl {r.randrange(24):02d}:{r.randrange(60):02d}"))
    if "rgan" in frame or "Orgnr" in frame:
        return f"{r.choice(('556', '559', '802', '969'))}{n(3)}-{n(4)}"
    if "Version" in frame:
        return f"{n(1)}.{n(2)}.{n(1)}"
    if any(x in frame for x in ("kost", "Saldo", "stod")):
        return f"{n(2)} {n(3)} {n(3)} kr" if r.random() < 0.6 else f"{n(1)} {n(3)} kr"
    return r.choice((f"{n(5)}-{n(4)}", f"{n(3)}.{n(3)}.{n(2)}", n(10), f"2023{n(4)}-{n(4)}", f"07{n(8)}", n(6), f"0{n(7)}"))


def fill(frame: str, r: random.Random, given: str, family: str) -> str:
    out = []
    for part in frame.split(" "):
        core = part.strip("[]().,:!?\n/@")
        for old, new in (("G_82", given + "_82"), ("Gs", given + ("" if given[-1] in "sxz" else "s")), ("G", given), ("F", family)):
            if core == old or core in (old + ",", old + "]") or (part.startswith(old) and len(part) > len(old) and not part[len(old)].isalpha()):
                part = part.replace(old, new, 1)
                break
        out.append(part)
    text = " ".join(out)
    text = text.replace("\nG F]", f"\n{given} {family}]").replace("//[name G]", f"//[name {given}]").replace("/[name G]", f"/[name {given}]")
    makers = {
        "P": lambda: phone(r), "K": lambda: r.choice("ABEFHLSV"), "I": lambda: identity(r), "A": lambda: address(r), "E": lambda: mailbox(r, given), "N": lambda: number(r, frame), "T": lambda: r.choice(TOWNS),
        "S": lambda: " ".join([r.choice(("noll", "noll", "plus")), *(r.choice(DIGITS) for _ in range(r.randrange(7, 10)))]), "W": lambda: (r.choice(("", "Norra ", "Gamla ")) + (r.choice(STEMS) + r.choice(ENDS))).strip().title(),
    }
    words = []
    for word in text.split(" "):
        core = word.strip("[]().,:!?\n")
        if core in makers:
            word = word.replace(core, makers[core](), 1)
        elif core == "D":
            plain = r.choice(PLAIN)
            word = word.replace("D", plain.capitalize() if not words else plain, 1)
        words.append(word)
    return " ".join(words)


def documents(names: list[str], n: int = 3600, seed: int = 3) -> list[str]:
    """n marked documents of one to four sentences; some repeat a name, some are in lower, upper or title case."""
    r, out = random.Random(seed), []
    for i in range(n):
        pick = r.random()
        given = r.choice(RARE) if pick < 0.2 else r.choice(PLAIN).capitalize() if pick < 0.42 else "-".join(p.capitalize() for p in r.choice(names).split("-"))
        family = r.choice(FAMILY) + r.choice(FAMILY_ENDS)
        frames = [WITH[i % len(WITH)]] if i % 5 else [r.choice(WITHOUT)]
        listed = given not in RARE
        if not listed and not any(c in frames[0] for c in ("heter", "Handläggaren", "Enligt", "kallar", "Prata med", "Mvh", "Hälsningar", "//")):
            given, listed = "Maria", True
        frames += [r.choice(WITHOUT) for _ in range(r.randrange(3))]
        if "[name G" in frames[0] and r.random() < (0.9 if given in RARE else 0.4):
            frames += r.sample(AGAIN, 1 + (given in RARE))
        parts = [fill(f.replace("\\n", "\n"), r, given.lower() if f in AGAIN and r.random() < 0.4 else given, family) for f in frames]
        text = ". ".join(parts)
        mode = r.random()
        out.append(cased(text, str.lower) if mode < 0.18 else cased(text, str.upper) if mode < 0.26 else cased(text, str.title) if mode < 0.3 else text)
    return out


def cased(text: str, case) -> str:
    """The text in another case, with the marks kept."""
    return "".join(("[" + p.split(" ", 1)[0] + " " + case(p.split(" ", 1)[1])) if p.startswith(("name ", "phone ", "id_number ", "address ", "email ")) else (("[" if k else "") + case(p)) for k, p in enumerate(text.split("[")))
