"""Which language a short text is in: by script, by function words of five languages and by character n-grams of many."""

from __future__ import annotations

import re
from collections import Counter
from math import log

import numpy as np

CODES = ("en", "de", "fr", "es", "pt")
# Frequent function words of the languages that most texts are in.
WORDS = {
    "en": "the is was were and to of that it for you your with my not will this have has from by are at before but which can we our they would should please when until how why what there here been does do did its he she i a an be so or if than then only new into about after out up them their who where could don't can't won't",
    "de": "der die das den dem des und ist nicht ich sie wir mit für auf ein eine einen einem einer es seit von haben habe hat im wie kann warum mir ihnen ihr ihre bitte schon zu auch wurde wurden sich bei bis als war sind nach durch aus wenn werden wird keine kein ihn dass oder aber noch nur zum zur vom am",
    "fr": "le la les et est une un pas je vous nous de des du pour avec que qui dans sur il elle ne par depuis déjà pourquoi comment sont au aux ce cette votre vos mon ma mes notre en se son sa ses ou mais donc été avoir être plus très peut tout c'est n'est j'ai d'un",
    "es": "el los las y es una un no que de por con para se mi me lo su sus del al desde cada ya esta está este esto hemos ha han cómo qué más sin pero muy usted ustedes nos ser era fue porque cuando donde puede tiene ni le les son hay antes solo dos veces hola gracias caso pedido tienda",
    "pt": "o os as e é um uma não que de por com para se meu minha me do da dos das pelo pela desde já no na nos nas foi era como ao aos à seu sua seus mas muito você ser está porque quando onde pode tem nem isso isto esse essa este esta há antes apenas são em ou duas vezes olá obrigado pedido loja processo",
}
LETTERS = {"de": "ß", "fr": "œêîôû", "es": "ñ¿¡", "pt": "ãõ"}
# A passage of each language that is written in Latin letters, for its n-grams.
PASSAGES = {
    "en": "All human beings are born free and equal in dignity and rights. They have reason and conscience and should act towards one another in a spirit of brotherhood. Please check whether the cable is plugged in and wait until the light turns green. We will send you a new part next week, you do not have to pay for anything. Thank you for your message, we are looking into what happened yesterday.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. Bitte prüfen Sie, ob das Kabel eingesteckt ist, und warten Sie, bis das Licht grün leuchtet. Wir schicken Ihnen nächste Woche ein neues Teil, Sie müssen dafür nichts bezahlen. Vielen Dank für Ihre Nachricht, wir sehen nach, was gestern geschehen ist.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Vérifiez que le câble est branché et attendez que le voyant devienne vert. Nous vous enverrons une nouvelle pièce la semaine prochaine, vous n'avez rien à payer. Merci pour votre message, nous regardons ce qui s'est passé hier.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. Compruebe que el cable está enchufado y espere hasta que la luz se ponga verde. La próxima semana le enviaremos una pieza nueva, no tiene que pagar nada. Gracias por su mensaje, estamos viendo qué pasó ayer.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Verifique se o cabo está ligado e espere até a luz ficar verde. Na próxima semana enviaremos uma peça nova, não tem de pagar nada. Obrigado pela sua mensagem, estamos a ver o que aconteceu ontem.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. Controlli che il cavo sia collegato e aspetti finché la luce non diventa verde. La settimana prossima le manderemo un pezzo nuovo, non deve pagare niente. Grazie per il suo messaggio, stiamo guardando che cosa è successo ieri.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten en behoren zich jegens elkander in een geest van broederschap te gedragen. Controleer of de kabel is aangesloten en wacht tot het lampje groen wordt. Volgende week sturen wij u een nieuw onderdeel, u hoeft niets te betalen. Bedankt voor uw bericht, we kijken wat er gisteren is gebeurd.",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap. Kontrollera att kabeln är ansluten och vänta tills lampan lyser grönt. Nästa vecka skickar vi en ny del till dig, du behöver inte betala något. Tack för ditt meddelande, vi tittar på vad som hände igår.",
    "da": "Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd. Undersøg, om kablet er sat i, og vent, til lampen lyser grønt. Næste uge sender vi dig en ny del, du skal ikke betale noget. Tak for din besked, vi kigger på, hvad der skete i går.",
    "nb": "Alle mennesker er født frie og med samme menneskeverd og menneskerettigheter. De er utstyrt med fornuft og samvittighet og bør handle mot hverandre i brorskapets ånd. Sjekk om kabelen er koblet til, og vent til lampen lyser grønt. Neste uke sender vi deg en ny del, du trenger ikke å betale noe. Takk for meldingen din, vi ser på hva som skjedde i går.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Tarkista, että johto on kytketty, ja odota, kunnes valo muuttuu vihreäksi. Lähetämme ensi viikolla uuden osan, sinun ei tarvitse maksaa mitään. Kiitos viestistäsi, katsomme mitä eilen tapahtui.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Proszę sprawdzić, czy kabel jest podłączony, i poczekać, aż lampka zaświeci się na zielono. W przyszłym tygodniu wyślemy nową część, nie trzeba nic płacić. Dziękujemy za wiadomość, sprawdzamy, co się wczoraj stało.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství. Zkontrolujte prosím, zda je kabel zapojený, a počkejte, až se rozsvítí zelené světlo. Příští týden vám pošleme nový díl, nemusíte nic platit. Děkujeme za zprávu, díváme se, co se včera stalo.",
    "sk": "Všetci ľudia sa rodia slobodní a sebe rovní, čo sa týka ich dôstojnosti a práv. Sú obdarení rozumom a svedomím a majú navzájom jednať v bratskom duchu. Skontrolujte prosím, či je kábel zapojený, a počkajte, kým sa rozsvieti zelené svetlo. Budúci týždeň vám pošleme nový diel, nemusíte nič platiť. Ďakujeme za správu, pozeráme sa, čo sa včera stalo.",
    "ro": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității. Verificați dacă este conectat cablul și așteptați până când lumina devine verde. Săptămâna viitoare vă trimitem o piesă nouă, nu trebuie să plătiți nimic. Mulțumim pentru mesaj, ne uităm ce s-a întâmplat ieri.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek. Kérjük, ellenőrizze, hogy a kábel be van-e dugva, és várjon, amíg a fény zöldre vált. A jövő héten küldünk egy új alkatrészt, nem kell fizetnie érte semmit. Köszönjük az üzenetét, megnézzük, mi történt tegnap.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. Lütfen kablonun takılı olup olmadığını kontrol edin ve ışık yeşile dönene kadar bekleyin. Gelecek hafta size yeni bir parça göndereceğiz, hiçbir şey ödemenize gerek yok. Mesajınız için teşekkürler, dün ne olduğuna bakıyoruz.",
    "hr": "Sva ljudska bića rađaju se slobodna i jednaka u dostojanstvu i pravima. Ona su obdarena razumom i sviješću i trebaju jedna prema drugima postupati u duhu bratstva. Provjerite je li kabel uključen i pričekajte dok svjetlo ne postane zeleno. Sljedeći tjedan šaljemo vam novi dio, ne morate ništa platiti. Hvala na poruci, gledamo što se jučer dogodilo.",
    "ca": "Tots els éssers humans neixen lliures i iguals en dignitat i en drets. Són dotats de raó i de consciència, i han de comportar-se fraternalment els uns amb els altres. Comproveu que el cable està endollat i espereu que el llum es posi verd. La setmana que ve us enviarem una peça nova, no heu de pagar res. Gràcies pel vostre missatge, estem mirant què va passar ahir.",
    "id": "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan. Silakan periksa apakah kabel sudah terpasang dan tunggu sampai lampu menjadi hijau. Minggu depan kami akan mengirim bagian yang baru, Anda tidak perlu membayar apa pun. Terima kasih atas pesan Anda, kami sedang melihat apa yang terjadi kemarin.",
    "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền. Mọi con người đều được tạo hóa ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình anh em. Vui lòng kiểm tra xem dây cáp đã được cắm chưa và đợi đến khi đèn chuyển sang màu xanh. Tuần tới chúng tôi sẽ gửi cho bạn một bộ phận mới, bạn không phải trả tiền. Cảm ơn bạn đã nhắn tin.",
    "et": "Kõik inimesed sünnivad vabadena ja võrdsetena oma väärikuselt ja õigustelt. Neile on antud mõistus ja südametunnistus ja nende suhtumist üksteisesse peab kandma vendluse vaim. Palun kontrollige, kas kaabel on ühendatud, ja oodake, kuni tuli muutub roheliseks. Järgmisel nädalal saadame teile uue osa, te ei pea midagi maksma. Täname sõnumi eest, vaatame, mis eile juhtus.",
}
# Frequent function words of further languages; they add to the passages.
FURTHER_WORDS = {
    "it": "il lo la gli le un una di da del della dello nella dalla con su per tra che non è sono ha ho hai questo questa anche più come quando dove perché se ma o ci si mi ti vi piccolo piccola",
    "nl": "de het een van en in is dat op te zijn met voor niet aan er om ook als maar bij uit naar nog dan wel hij ze wij jullie heeft heb werd deze dit kleine geen meer over haar mijn uw",
    "sv": "och att det som en ett är av för den till på med de inte om han hon vi ni jag har var från ut ur så men eller när hur kan ska din min lilla ta också mycket bara",
    "da": "og at det som en et er af for den til på med de ikke om han hun vi jeg har var fra ud så men eller når hvordan kan skal din min lille tag også meget kun blev mig af hvad",
    "nb": "og at det som en et er av for den til på med de ikke om han hun vi jeg har var fra ut så men eller når hvordan kan skal din min lille ta også mye bare ble meg hva noe esken",
    "fi": "ja on ei se että oli hän minä sinä me te he mutta tai kun jos niin kuin myös vain nyt tämä joka mitä missä kanssa sitten ole ovat pieni ota laatikko talo vielä hyvä paljon",
    "pl": "i w na z się nie to jest że do o jak po co ale za od czy tak ja ty on ona my wy oni dla przez przy już tylko może jeszcze być ma są mały małą proszę bardzo gdzie kiedy",
    "cs": "a v na s se ne to je že do o jak po co ale za od ano já ty on ona my vy oni pro přes při už jen může ještě být má jsou malý prosím velmi kde když který vyndejte krabice",
    "sk": "a v na s sa nie to je že do o ako po čo ale za od áno ja ty on ona my vy oni pre cez pri už len môže ešte byť má sú malý malú prosím veľmi kde keď ktorý zo škatuľa skrutka",
    "ro": "și în la cu nu este că de pe un o mai din ce sau dar pentru el ea noi voi ei care când unde cum dacă are sunt foarte mic acest această fără după",
    "hu": "a az és hogy nem is van egy ez meg de csak már ha vagy mint még volt ki be el fel le kell nagyon kis mi ti ők én te ő ahol amikor mert dobozból vegye tegye",
    "tr": "ve bir bu için de da ile çok ne değil var yok ama ben sen biz siz onlar gibi daha kadar sonra olarak olan mı mi küçük lütfen nerede nasıl çünkü kutudan kutu çıkarın koyun açın",
    "hr": "i u na s se ne to je da do o kako po što ali za od ja ti on ona mi vi oni prije pri već samo može još biti ima su mali molim vrlo gdje kad koji iz kutija izvadite",
    "ca": "el la els les un una de del amb no és que per en i a al com més però o si quan on aquest aquesta són té molt petit des sense fins també hem ha",
    "id": "dan yang di ke dari untuk dengan ini itu tidak ada akan adalah pada saya kamu dia kita mereka bisa sudah atau juga tetapi karena kecil sangat dalam lagi kotak keluarkan",
    "vi": "và của là có không cho với được một những các trong này đó khi nào tôi bạn chúng ta họ đã sẽ rất nhỏ ra khỏi vào hộp lấy nhưng hoặc vì",
    "et": "ja on ei see et oli ta ma sa me te nad aga või kui nii nagu ka ainult nüüd mis kus kellega siis ole väike väga veel hea palju võtke karp karbist kruvi välja sisse",
}
# Scripts that tell the language, or the most usual one, of a text; the first that fits counts.
SCRIPTS = (
    ("ja", "[぀-ヿ]"), ("ko", "[가-힯ᄀ-ᇿ]"), ("zh", "[㐀-鿿]"), ("uk", "[іїєґІЇЄҐ]"), ("ru", "[Ѐ-ӿ]"), ("el", "[Ͱ-Ͽἀ-῿]"), ("he", "[֐-׿]"),
    ("fa", "[پچژگ]"), ("ar", "[؀-ۿ]"), ("hi", "[ऀ-ॿ]"), ("bn", "[ঀ-৿]"), ("ta", "[஀-௿]"), ("th", "[฀-๿]"), ("ka", "[Ⴀ-ჿ]"), ("hy", "[԰-֏]"),
)
#: Scripts whose letters also stand in texts of another language of the list before it: groups that share letters.
_FAMILY = {"ja": "[぀-ヿ㐀-鿿]", "uk": "[Ѐ-ӿ]", "fa": "[؀-ۿ]"}
# Names of the languages in each other and in themselves.
NAMES = {
    "en": "english englisch anglais inglés inglês inglese engels engelska angielsku английском английски",
    "de": "german deutsch allemand alemán alemão tedesco duits tyska niemiecku немецком",
    "fr": "french französisch français francés francês francese frans franska francusku французском",
    "es": "spanish spanisch espagnol español espanhol castellano spagnolo spaans spanska испанском",
    "pt": "portuguese portugiesisch portugais portugués português portoghese portugees portugisiska португальском",
    "it": "italian italienisch italien italiano", "nl": "dutch niederländisch néerlandais neerlandés neerlandês nederlands", "sv": "swedish schwedisch suédois sueco svenska", "da": "danish dänisch danois danés dansk", "nb": "norwegian norwegisch norvégien noruego norsk",
    "fi": "finnish finnisch finnois finlandés suomi suomeksi", "pl": "polish polnisch polonais polaco polski polsku", "cs": "czech tschechisch tchèque checo česky češtině", "ru": "russian russisch russe ruso russo русском русски", "uk": "ukrainian ukrainisch ukrainien ucraniano українською",
    "tr": "turkish türkisch turc turco türkçe", "ar": "arabic arabisch arabe árabe العربية", "zh": "chinese chinesisch chinois chino chinês 中文", "ja": "japanese japanisch japonais japonés japonês 日本語", "ko": "korean koreanisch coréen coreano 한국어", "el": "greek griechisch grec griego grego ελληνικά",
    "hu": "hungarian ungarisch hongrois húngaro magyarul", "ro": "romanian rumänisch roumain rumano romeno română", "hi": "hindi हिन्दी", "vi": "vietnamese vietnamesisch vietnamien vietnamita", "id": "indonesian indonesisch indonésien indonesio", "he": "hebrew hebräisch hébreu hebreo עברית", "th": "thai ไทย",
}

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CODED = re.compile(r"[^\s\d@/]*[\d@/]\S*")
_LETTER = re.compile(r"[^\W\d_]")
_ALL = {c: frozenset(ws.split()) for c, ws in WORDS.items()}
#: Words of one language only count whole, those of several a part.
_OWN = {c: ws - frozenset().union(*[o for d, o in _ALL.items() if d != c]) for c, ws in _ALL.items()}
_WEIGHT: dict[str, tuple[tuple[int, float], ...]] = {}
for _w in frozenset().union(*_ALL.values()):
    _WEIGHT[_w] = tuple((k, 1.0 if _w in _OWN[c] else 0.35) for k, c in enumerate(CODES) if _w in _ALL[c])
_NAMED = {n: c for c, ns in NAMES.items() for n in ns.split()}
_ASK = re.compile(
    r"(?:answer|reply|respond|write|translat\w+|antwort\w*|schreib\w*|übersetz\w*|répon\w*|écri\w*|tradui\w*|respond\w*|contest\w*|escrib\w*|traduz\w*|traduc\w*|escrev\w*|rispond\w*|antwoord\w*|svara|odpowiedz|ответ\w*|напиш\w*)"
    r"\W+(?:[^\W\d_]+\W+){0,4}?(?:in|into|auf|ins|en|em|al|para|på|po|на|по)\W+(" + "|".join(sorted(map(re.escape, _NAMED), key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE
)
_SCRIPTS = [(code, re.compile(sign), re.compile(_FAMILY.get(code, sign))) for code, sign in SCRIPTS]
#: Weight of what all languages have in common, against that of a language's own passage.
_COMMON = 0.25
#: n-grams of a language speak if it leads the next one by so much per n-gram and in all.
LEAD_EACH, LEAD_ALL = 0.1, 9.0
#: Words that a text must have for its n-grams to speak.
LEAST_WORDS = 4


def _grams(text: str) -> list[str]:
    out = []
    for word in _TOKEN.findall(text.lower()):
        w = f" {word} "
        out += [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]
    return out


def _trained() -> dict[str, dict[str, float]]:
    counts = {c: Counter(_grams(p + " " + " ".join((WORDS | FURTHER_WORDS)[c].split()[:50]))) for c, p in PASSAGES.items()}
    totals = {c: sum(n.values()) for c, n in counts.items()}
    every = Counter()
    for c, n in counts.items():
        for g, k in n.items():
            every[g] += k / totals[c] / len(counts)
    weights: dict[str, dict[str, float]] = {}
    for g, common in every.items():
        weights[g] = {c: log((1 - _COMMON) * n[g] / totals[c] / common + _COMMON) for c, n in counts.items()}
    return weights


_ORDER = tuple(PASSAGES)
_KNOWN = _trained()
_ROWS = {g: i for i, g in enumerate(_KNOWN)}
_WEIGHTS = np.array([[w[c] for c in _ORDER] for w in _KNOWN.values()])


def script_of(text: str) -> str | None:
    """The language of the script that most letters are of, None for Latin letters and for none."""
    if text.isascii():
        return None
    letters = len(_LETTER.findall(text))
    for code, sign, family in _SCRIPTS:
        if sign.search(text) and 2 * len(family.findall(text)) > letters:
            return code
    return None


def by_ngrams(text: str) -> tuple[str | None, float]:
    """The language in Latin letters whose n-grams lead clearly, and by how much."""
    rows = [i for g in _grams(_CODED.sub(" ", text)) if (i := _ROWS.get(g)) is not None]
    if not rows:
        return None, 0.0
    sums = _WEIGHTS[rows].sum(axis=0)
    second, best = np.argsort(sums)[-2:]
    lead = float(sums[best] - sums[second])
    return (_ORDER[best] if lead >= LEAD_ALL and lead >= LEAD_EACH * len(rows) else None), lead


def evidence(text: str) -> tuple[float, ...]:
    """How much the function words speak for each of ``CODES``; numbers, codes and addresses say nothing."""
    lower = _CODED.sub(" ", text.lower())
    tokens = set(_TOKEN.findall(lower))
    if "'" in lower or "’" in lower:
        apart = [t.replace("’", "'") for t in tokens if "'" in t or "’" in t]
        tokens.update(apart, [t.split("'", 1)[1] for t in apart])
    total = [0.0] * len(CODES)
    for token in tokens:
        for k, weight in _WEIGHT.get(token, ()):
            total[k] += weight
    if not lower.isascii():
        for code, letters in LETTERS.items():
            total[CODES.index(code)] += 1.5 * sum(x in lower for x in letters)
    return tuple(total)


def decide(total: tuple[float, ...], least: float = 1.5, lead: float = 1.0) -> str | None:
    """The language if the evidence suffices and leads clearly enough, else None."""
    ranked = sorted(range(len(CODES)), key=lambda i: -total[i])
    best, second = ranked[0], ranked[1]
    return CODES[best] if total[best] >= least and total[best] - total[second] >= lead else None


def language(text: str, least: float = 1.5, lead: float = 1.0) -> str | None:
    """The language of a text, None if nothing tells it clearly.

    A script decides at once, and so do many function words of one language between blanks. Function words of the five languages and n-grams must not contradict each
    other: n-grams of another language win only over a weak lead of the words.
    """
    if (script := script_of(text)) is not None:
        return script
    enough = 3 * max(least, 1.0)
    total = [0.0] * len(CODES)
    for token in set(text.lower().split()):
        for k, weight in _WEIGHT.get(token, ()):
            total[k] += weight
    top = max(total)
    if top >= enough and sum(x > top - 2.5 for x in total) == 1:
        return CODES[total.index(top)]
    total = evidence(text)
    words = decide(total, least, lead)
    if words is not None and max(total) >= enough:
        return words
    grams = by_ngrams(text)[0] if len(_TOKEN.findall(text)) >= LEAST_WORDS else None
    if grams is None or grams == words:
        return words
    return grams if words is None or grams not in CODES else words


def asked_for(text: str) -> str | None:
    """The language that a text asks its answer to be in."""
    found = _ASK.search(text)
    return _NAMED[found.group(1).lower()] if found else None
