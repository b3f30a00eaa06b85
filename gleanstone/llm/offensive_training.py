"""Training sentences of the offensive-content models, composed of short word lists by frames.

In a frame ``{x}`` stands for any word of list ``x`` of its language; a frame that begins with ``~`` is mirrored:
with harmless words in its places it is ordinary, so that its own words tell nothing. Every frame gives at most
``PER_FRAME`` sentences, drawn with a fixed seed, so that the number of sentences is the same at every
data size. Both classes use the same groups, adjectives and subjects, so that these alone tell nothing.
"""

from __future__ import annotations

import itertools
import random
import re

PER_FRAME = 40
SEED = 20260110

# Word lists of the frames, by language.
LISTS = {
    "en": {
        "n": "idiot moron imbecile fool loser scumbag bastard asshole bitch cunt prick dickhead jerk dumbass pig worm cretin halfwit twat wanker slut whore maggot clown parasite freak retard dimwit dirtbag",
        "a": "stupid dumb pathetic worthless useless filthy disgusting ugly lying fat fucking bloody",
        "v": "kill stab shoot beat strangle hurt rape choke punch murder hunt slap",
        "p": "killed stabbed shot beaten strangled hurt raped choked punched murdered hanged burned",
        "g": "foreigners|immigrants|refugees|muslims|jews|christians|black people|gypsies|women|girls|gays|disabled people|old people|those people|asians|believers|hill people|people like them",
        "b": "dick cock pussy tits ass boobs cunt balls nipples",
        "t": "printer cable app form website lamp update design button manual camera battery kettle parcel refund service",
        "o": "call help pay visit ask meet thank remind invite join",
        "y": "abusive hateful offensive toxic sexual racist insulting violent",
        "h": "meter filter wire case socket cover switch knob lid cord",
        "k": "kind right welcome great helpful amazing wonderful patient polite nearly done",
        "w": "today tomorrow tonight soon here now",
    },
    "de": {
        "n": "idiot vollidiot trottel versager arschloch schwein hure schlampe wichser penner missgeburt spast depp dummkopf drecksau bastard hurensohn fotze",
        "a": "dummes blödes dreckiges widerliches nutzloses verlogenes hässliches",
        "v": "umbringen abstechen verprügeln erschießen erwürgen schlagen vergewaltigen töten",
        "g": "ausländer|flüchtlinge|muslime|juden|christen|schwarze|zigeuner|frauen|schwule|behinderte|alte leute|solche leute",
        "b": "titten schwanz arsch muschi brüste",
        "t": "drucker akku lampe kamera heizung lieferung rechnung app seite anleitung",
        "o": "anrufen bezahlen besuchen fragen abholen einladen erinnern",
        "k": "nett freundlich hilfsbereit geduldig willkommen fertig",
    },
    "fr": {
        "n": "idiot connard connasse abruti imbécile salope pute enculé crétin ordure bâtard débile merdeux raclure",
        "a": "sale pauvre gros vieux",
        "v": "tuer frapper égorger étrangler violer buter crever massacrer",
        "g": "étrangers|réfugiés|musulmans|juifs|noirs|femmes|homosexuels|handicapés|vieux|gens comme ça|immigrés",
        "b": "bite chatte seins cul nichons",
        "t": "imprimante batterie lampe caméra livraison facture application page notice",
        "o": "appeler aider payer voir rendre attendre chercher prévenir",
        "k": "gentil aimable patient serviable bienvenu prêt",
    },
    "es": {
        "n": "idiota imbécil gilipollas cabrón puta zorra estúpido basura mierda subnormal perra malnacido pendejo",
        "a": "maldito asqueroso jodido sucio pobre",
        "v": "matar golpear apuñalar estrangular violar reventar disparar",
        "g": "extranjeros|refugiados|musulmanes|judíos|negros|mujeres|gays|discapacitados|viejos|inmigrantes|gitanos",
        "b": "polla coño tetas culo verga",
        "t": "impresora batería lámpara cámara entrega factura aplicación página manual",
        "o": "llamar ayudar pagar ver devolver esperar visitar avisar",
        "k": "amable paciente educado genial bienvenido atento",
    },
    "pt": {
        "n": "idiota imbecil otário cabrão puta vadia estúpido lixo merda retardado cretino verme desgraçado",
        "a": "maldito nojento porco sujo pobre",
        "v": "matar bater esfaquear estrangular violar rebentar espancar",
        "g": "estrangeiros|refugiados|muçulmanos|judeus|negros|mulheres|gays|deficientes|velhos|imigrantes|ciganos",
        "b": "pau buceta mamas cu caralho",
        "t": "impressora bateria lâmpada câmara entrega fatura aplicação página manual",
        "o": "ligar ajudar pagar ver devolver esperar visitar avisar",
        "k": "simpático paciente educado ótimo bem-vindo atencioso",
    },
    "it": {
        "n": "idiota imbecille stronzo coglione bastardo puttana troia cretino deficiente merda verme",
        "a": "brutto schifoso lurido maledetto povero",
        "v": "ammazzare picchiare accoltellare strangolare violentare uccidere",
        "g": "stranieri|profughi|musulmani|ebrei|neri|donne|gay|disabili|vecchi|zingari",
        "b": "cazzo figa tette culo",
        "t": "stampante batteria lampada telecamera consegna fattura applicazione pagina",
        "o": "chiamare aiutare pagare vedere restituire aspettare avvisare",
        "k": "gentile paziente bravo cortese benvenuto",
    },
    "ru": {
        "n": "идиот дебил сука тварь мразь ублюдок кретин придурок урод дура скотина шлюха гад",
        "a": "тупой тупая жалкий мерзкий грязный",
        "v": "убью зарежу придушу изобью застрелю закопаю",
        "g": "мигранты|беженцы|мусульмане|евреи|женщины|иностранцы|инвалиды|старики|цыгане",
        "b": "хуй член сиськи жопу",
        "t": "принтер лампа камера доставка приложение страница чайник",
        "o": "позвоню помогу заплачу подожду напишу встречу",
        "k": "добры правы вежливы молодец терпеливы",
    },
}
# Frames of offensive sentences (insults, threats, degradation of groups, sexual talk).
TOXIC = {
    "en": """~{n}|~you {n}|~you {a} {n}|~you are a {n}|~you're a {a} {n}|~you are such a {n}|~what a {a} {n} you are|shut up {n}|shut up you {a} {n}|shut the fuck up {n}|get lost you {n}|~only a {n} could say so|~everyone here knows you are a {n}|are you a {n} or just {a}|~your team is a bunch of {n}s|~the {n} at your desk should be ashamed|you {a} sack of shit|you people are {a}|~i bet your mother is a {n} too|u {n}|~u are a {n}|~ur a {n}|ur such a {n} lol|~lol {n}|~{n} lol
fuck you|fuck you all|fuck you {n}|fuck off|go fuck yourself|fuck your family|piss off {n}|eat shit|eat shit and die|screw you {n}|suck my {b}|kiss my ass|drop dead|rot in hell|go to hell {n}|i hate you and your family|nobody would miss you|go hang yourself|just kill yourself|please die {w}|die {n}|i hope you die|i hope you get cancer|you should never have been born|you disgust me you {n}
~i will {v} you|~i'm going to {v} you {w}|~i am going to {v} you|~we will {v} your children|~i'll {v} you and your family|~somebody should {v} you|somebody ought to {v} you with a knife|~you deserve to be {p}|~you are going to be {p}|~i hope you get {p}|~i know where you live and i will {v} you|~i will come to your house and {v} you|you will pay for this with blood|~wait until i find you {n}|i'll break your legs|i will burn your house down|one day you will bleed {n}
{g} are vermin|{g} are scum|{g} are subhuman scum|{g} are animals|{g} are filth|{g} are all thieves|{g} are too {a} to work|{g} are a disease|{g} should be exterminated|~{g} should be {p}|{g} should be locked away|{g} don't belong here|{g} have no right to live|{g} breed like rats|get rid of all {g}|i hate {g}|i hate all {g} they are {a}|send all {g} back where they came from|no {g} at this counter they are {a}|your race should be exterminated|your kind is inferior and dirty|keep {g} away from decent people|{g} are not human|{g} deserve what they get|gas the {g}|i won't talk to {g} they are {a}|{g} belong in the kitchen
send me nudes|send me naked pictures {w}|i want to fuck you {w}|i want to fuck her {b}|i want you naked in my bed|~show me your {b}|~show your {b} baby|lick my {b}|let me lick your {b}|i want to lick you|~i want to lick your {b}|i want to lick and kiss you all over|~i'd love to kiss your naked {b}|i am so horny|i'm so horny for you baby|take off your clothes for me|spread your legs|~touch my {b}|~put my {b} in your mouth|she rode his {b}|she sucked his {b} until he came|he came inside her|~her {b} hardened as he thrust deeper|touch yourself for me baby|i would bang that {n}|hot {n}s are waiting for you|what are you wearing in bed sweetie|she moaned as he undressed her|he ripped her dress off and pushed inside her|come sit on my {b}""",
    "de": """~{n}|~du {n}|du {a} {n}|~du bist ein {n}|~ihr seid alle {n}|~was für ein {n}|halt die klappe du {n}|halts maul|halt dein maul {n}|halt die schnauze|verpiss dich {n}|fick dich|fick dich du {n}|geh sterben|stirb endlich|ich hoffe du stirbst|leck mich am arsch|du kotzt mich an du {n}|bring dich um|niemand würde dich vermissen|~nur ein {n} schreibt so etwas|~deine mutter ist eine {n}|zur hölle mit dir {n}
~ich werde dich {v}|~ich will dich {v}|~wir werden dich {v}|~man sollte dich {v}|~ich weiß wo du wohnst und werde dich {v}|dafür wirst du bluten du {n}|ich breche dir die beine|ich zünde dein haus an|pass auf sonst mache ich dich kalt
{g} sind ungeziefer|{g} sind abschaum|{g} sind dreck|{g} sind tiere|{g} gehören vergast|{g} gehören weggesperrt|{g} sollte man erschießen|{g} raus|alle {g} raus aus unserem land|{g} sind zu dumm zum denken|ich hasse {g}|{g} sind untermenschen|{g} haben hier nichts verloren|{g} gehören in die küche
schick mir nacktfotos|~zeig mir deine {b}|ich will dich ficken|lutsch meinen {b}|ich bin so geil|zieh dich aus süße|ich will dich nackt sehen|mach die beine breit|er steckte ihr seinen {b} rein|sie stöhnte als er tiefer stieß""",
    "fr": """~{n}|sale {n}|pauvre {n}|espèce de {n}|~tu es un {n}|~quel {n}|~vous êtes tous des {n}s|ferme-la {n}|ta gueule|ferme ta gueule {n}|va te faire foutre|va te faire enculer|nique ta mère|va crever|crève {n}|va mourir|dégage {n}|casse-toi {n}|je te déteste {n}|~ta mère est une {n}|suicide-toi|personne ne te regretterait|il faut être un {n} pour écrire ça
~je vais te {v}|~on va te {v}|~je vais venir te {v}|tu mérites de mourir|~je sais où tu habites et je vais te {v}|je vais te casser les jambes|je vais brûler ta maison|tu vas saigner {n}|tu vas le payer de ton sang
les {g} sont de la vermine|les {g} sont des animaux|les {g} sont des parasites|les {g} sont tous des voleurs|dehors les {g}|il faut exterminer les {g}|il faut renvoyer tous les {g}|je hais les {g}|les {g} sont trop bêtes pour penser|les {g} sont des sous-hommes|les {g} n'ont rien à faire ici|qu'on enferme les {g}
envoie-moi des photos nue|envoie tes {b}|~montre-moi tes {b}|suce ma {b}|je veux te baiser|j'ai envie de te baiser|déshabille-toi pour moi|je suis tout excité viens dans mon lit|écarte les jambes|elle gémissait pendant qu'il la pénétrait""",
    "es": """~{n}|~eres un {n}|~eres una {n}|pedazo de {n}|{a} {n}|~sois unos {n}s|~qué {n} eres|cállate {n}|cierra la boca {n}|vete a la mierda|vete a tomar por culo|que te jodan|jódete {n}|hijo de puta|chinga tu madre|muérete {n}|ojalá te mueras|púdrete {n}|te odio {n}|~tu madre es una {n}|suicídate|nadie te echaría de menos|solo un {n} escribe eso
~te voy a {v}|~voy a {v} a tu familia|~te vamos a {v}|~voy a ir a tu casa y te voy a {v}|mereces morir|sé dónde vives y te voy a {v}|te voy a romper las piernas|voy a quemar tu casa|vas a sangrar {n}
los {g} son basura|los {g} son ratas|los {g} son animales|los {g} son escoria|los {g} son todos ladrones|fuera los {g}|hay que echar a los {g}|hay que exterminar a los {g}|odio a los {g}|los {g} son demasiado tontos para pensar|los {g} no son humanos|los {g} a su país
mándame fotos desnuda|~enséñame las {b}|~enséñame el {b}|chúpame la {b}|quiero follarte|quiero follar contigo|estoy muy caliente ven a mi cama|quítate la ropa para mí|abre las piernas|ella gemía mientras él la penetraba""",
    "pt": """~{n}|seu {n}|~és um {n}|~você é um {n}|seu {n} de merda|{a} {n}|~que {n}|cala a boca {n}|cala-te {n}|vai à merda|vai tomar no cu|vai-te foder|foda-se {n}|filho da puta|morre {n}|espero que morras|odeio-te {n}|~a tua mãe é uma {n}|mata-te|ninguém sentiria a tua falta|só um {n} escreve isto|~são todos uns {n}s
~vou-te {v}|~vou te {v}|~vamos te {v}|~vou à tua casa e vou-te {v}|mereces morrer|~sei onde moras e vou te {v}|vou partir-te as pernas|vou queimar a tua casa|vais sangrar {n}
os {g} são lixo|os {g} são ratos|os {g} são animais|os {g} são escória|os {g} são todos ladrões|fora com os {g}|temos de expulsar os {g}|temos de exterminar os {g}|odeio os {g}|os {g} são burros demais para pensar|os {g} não são humanos|os {g} deviam desaparecer
manda fotos nua|manda nudes|~mostra-me as {b}|chupa o meu {b}|quero foder contigo|quero te comer na minha cama|estou cheio de tesão|tira a roupa para mim|abre as pernas|ela gemia enquanto ele a penetrava""",
    "it": """~{n}|~sei un {n}|~sei proprio un {n}|{a} {n}|pezzo di {n}|~che {n}|~siete tutti dei {n}|stai zitto {n}|chiudi la bocca {n}|vaffanculo|vai a farti fottere|figlio di puttana|fottiti {n}|muori {n}|spero che tu muoia|ti odio {n}|~tua madre è una {n}|ammazzati|solo un {n} scrive così
~ti voglio {v}|~vengo a casa tua e ti voglio {v}|ti ammazzo|ti spacco la faccia|so dove abiti e te la farò pagare col sangue|meriti di morire|brucerò la tua casa
gli {g} sono feccia|gli {g} sono animali|i {g} sono parassiti|fuori gli {g}|odio gli {g}|bisogna sterminare gli {g}|gli {g} sono tutti ladri|gli {g} non sono umani|le donne devono stare in cucina
mandami foto nuda|~fammi vedere le {b}|succhiami il {b}|voglio scoparti|sono eccitato vieni nel mio letto|spogliati per me|apri le gambe|lei gemeva mentre lui la penetrava""",
    "ru": """~{n}|~ты {n}|ты {a} {n}|~какой ты {n}|~вы все {n}|заткнись {n}|закрой рот {n}|закрой пасть {n}|иди на хуй|пошёл на хуй|пошел ты на хуй {n}|пошла ты {n}|иди в жопу|сдохни {n}|чтоб ты сдох {n}|ненавижу тебя {n}|~твоя мать {n}|убей себя|никто не будет по тебе плакать
~я тебя {v}|мы тебя найдём и я тебя {v}|~приду к тебе домой и {v}|я знаю где ты живёшь и {v} тебя|ты заслуживаешь смерти|ты заплатишь кровью {n}|сломаю тебе ноги|сожгу твой дом
{g} это мусор|{g} не люди|{g} животные|все {g} воры|{g} надо уничтожить|{g} вон отсюда|ненавижу всех|{g} слишком тупые чтобы думать|гнать надо этих тварей
пришли голые фото|~покажи {b}|хочу тебя трахнуть|соси мой {b}|раздевайся для меня|раздвинь ноги|она стонала когда он вошёл в неё""",
    "other": "操你妈|去死吧|你这个白痴|你是个傻逼|闭嘴你这个贱人|滚蛋|我要杀了你|这些外国人都是垃圾|发裸照给我|死ね|この馬鹿野郎|お前はバカだ|黙れクズ|殺してやる|外国人は出て行け|裸の写真を送れ|يا كلب|يا حقير|اخرس يا حمار|سأقتلك|أنت غبي|يا ابن العاهرة|klootzak|je bent een klootzak|hou je bek|kankerhoer|ik maak je dood|rot op|spierdalaj|ty kurwo|jesteś idiotą|zabiję cię|zamknij się debilu|orospu çocuğu|seni öldüreceğim|aptal herif|kapa çeneni",
}
# Frames of ordinary sentences, among them anger at things, technical and medical senses, reports and rules.
ORDINARY = {
    "en": """ur {k}|ur a {k} person|ur {t} is here lol|lol thanks|you are {k}|you are very {k}|you are a {k} colleague|you were {k} to me|you people were {k}|thank you|thank you all|hello|hello there|good morning|yes|no|okay|fine|hi {k} people|please wait|please call me {w}|send the label {w}|send me the receipt|send me the form {w}|show me your settings page|show the page again|i want to return the {t}|i want to see you {w}|i will call you {w}|i will send you the {t}|i'm going to call you {w}|we will write to you {w}|i know where you work|i hope you get well soon|i hope you find the {t}|somebody should call me|you will get a new {t}|you should never open the {t}|what a {k} answer|what are the wearing parts of the {t}|come to our house {w}|take off the cover of the {t}|take it to bed mode|let me see your {t}|put the {t} in your room|get rid of the {t}|your team is {k}|your mother is {k}|shut the lid|shut it down {w}|are you {k} or just busy|i want you to know|the {t} should be repaired|the {t} at your desk is new|only a new {t} could help|nobody answers {w}
this {t} is {a}|the {a} {t}|what a {a} {t}|the {a} {t} broke again|your {t} is {a}|i hate this {t}|i hate your {a} {t}|damn {t}|this damn {t} is crap|the {t} is shit|the {t} is a piece of shit|this {t} sucks|the {t} can go to hell|to hell with this {t}|this {t} is driving me mad|i am so angry about the {t}|your {t} is the worst|fucking {t} broke again|the {t} died {w}|the {t} is dead|bloody {t}|i want my money back|this is garbage|this is ridiculous|i am sick of this {t}|a joke of a {t}|it hurts my eyes
kill the process|kill the child process {w}|how do i kill a job|the {t} got killed by the system|abort and execute it again|the master and the slave drive|strip the wire|naked wire ends must not touch|the male plug fits the female socket|screw it into the bottom hole|push it in harder|shoot the photo again|i shot the video with it|beat the eggs|a punch list for the {t}|hit the button|hang up and dial again|the hanging rope of the {t}|burned in image on the {t}|choke valve of the {t}|a dummy plug|a dumb terminal|the cock of the valve|ball bearing and nipples of the hose|grease the nipples|it went deeper into the hole|the knife of the blender|bleed the radiator|the donkey or ass is an animal|a cocktail party|the cat pussy willow tree
breast cancer screening|the patient felt pain in her breasts|a doctor examined his penis|a sexual health clinic|leaflets on sexual education|the rape crisis helpline|she was raped and asked for help|he was beaten by his father|the child was hurt|his nipples are sore|she had vaginal bleeding|erection problems are common|a nude painting in the museum|with the naked eye|gay couples can marry|cancer of the testicles
he was convicted of murder|police said two people were stabbed|a man threatened to kill his wife|he said he would {v} her|three men were {p} in the riot|the court heard that she was {p}|the film shows how soldiers {v} each other|the article says that {g} were called vermin|please report hate speech|do not call anyone an {n}|words such as {n} are forbidden|insults are not allowed here|{y} messages are not allowed here|{y} or {y} comments are not permitted on this site|we remove {y} content|please report {y} replies|our rules forbid {y} language|users who post {y} texts get banned|do not send {y} pictures|the post was deleted because it called {g} {a}|a classifier flags sexual content|whoever calls others {n} will be banned|threats are reported to the police|he called me a {n} and i complained|the caller said {n} and hung up|the speaker condemned attacks on {g}|the judge marks whether an answer insults {g}|never write that {g} are {a}|the rule forbids to say {g} are scum
{g} work here|{g} are {k}|{g} are welcome here|many {g} live in the city|we help {g}|{g} pay the same price|{g} should be treated fairly|a law protects {g}|{g} came to the meeting|keep {g} informed|the rights of {g}|{g} and their families|i met {g} at work|send {g} the form|no {g} were there|all {g} get a card
the second charge was a mistake|the light turns green {w}|the parcel will arrive {w}|it stopped working after an hour|we checked the account|the desk closes soon|open the page and press the button|it weighs two kilos|my neighbour has one too|everyone here knows how it works|wait until the {t} is dry|the children like it|i found it on the back|one day later it came|i bet it works
{o} me {w}|i will {o} you|i'm going to {o} you {w}|i am going to {o} you|we will {o} your parents|somebody should {o} you|i know where you live and will {o} you|i will come to your house and {o} you|please {o} her|he said he would {o} her|wait until i find the {h}|i hope you like the {h}|i hope you had a good trip|open the {h}|shut the {h}|touch the {h}|spread it on the {h}|put the {h} in|lick the stamp|let me {o} you|show your {h} {w}|what are you looking for {w}|she moaned about the price|he ripped the {h} off|come sit on my chair|only a {k} person could say so|nobody would mind|just call {w}|go home {w}|a bunch of keys|the {h} deserves a repair|no right to a refund|a message to all {g}|they talked about {g} and prices|tell me {w}|if the {h} is loose tell us|the {h} pushes deeper into the wall|one {h} is a {a} copy of the other|read the {h} before use|take the {h} off|begin with the {h}|a fork and a spoon""",
    "de": """sie sind {k}|du bist {k}|du bist sehr {k}|ihr seid {k}|danke|vielen dank|hallo|guten tag|ja|nein|schicken sie mir die {t}|schick mir die rechnung|zeig mir deine seite|zeigen sie mir die {t}|ich will die {t} zurückgeben|ich werde dich anrufen|wir werden dich anrufen|ich weiß wo du arbeitest|die {t} ist scheiße|diese {t} ist dumm|so eine blöde {t}|verdammte {t}|ich hasse diese {t}|die {t} ist müll|das ist doch zum kotzen|was für eine schlechte {t}|ich will mein geld zurück|das kind hat sich verletzt|den prozess töten|der nackte draht|brustkrebs vorsorge|er wurde wegen mordes verurteilt|er drohte sie zu {v}|beleidigungen wie {n} sind verboten|er nannte mich {n}|bitte melden sie hass|{g} arbeiten hier|{g} sind willkommen|{g} haben die gleichen rechte|viele {g} leben hier|wir helfen {g}|{g} sind nett|der beitrag wurde gelöscht weil er {g} beleidigte|ziehen sie den stecker|ziehen sie den mantel aus|halt den knopf gedrückt|halten sie die taste|mach das licht an|man sollte die {t} prüfen|alle kunden raus aus dem laden bei feuer
ich werde dich {o}|ich will dich {o}|wir werden dich {o}|man sollte dich {o}|die {t} ist alt|der {t} geht nicht|das geht nicht|pass auf dass die {t} nicht fällt|zeig mir die {t}|ich habe alle {t} geprüft|geh nach hause|was für ein schöner tag|die familie kommt am montag|im wald leben tiere|stirb langsam heißt der film|niemand ist da|deine mutter ist {k}|nur ein kunde schreibt so etwas|ich breche den kauf ab|er steckte den stecker in die dose|bis freitag|am montag|mit der hand|zu klein|für die {t}|sie stöhnte über den preis""",
    "fr": """vous êtes {k}|tu es {k}|vous êtes tous {k}s|merci|bonjour|oui|non|envoyez-moi la {t}|envoie-moi la facture|montre-moi ta page|montrez-moi la {t}|je veux rendre la {t}|je vais te rappeler|on va te rappeler|je sais où tu travailles|cette {t} est nulle|quelle {t} de merde|cette putain de {t}|je déteste cette {t}|c'est de la merde cette {t}|la {t} est morte|je veux être remboursé|tuer le processus|le fil nu|cancer du sein|il a été condamné pour meurtre|il a menacé de la {v}|les insultes comme {n} sont interdites|il m'a traité de {n}|signalez la haine|les {g} travaillent ici|les {g} sont {k}s|les {g} sont les bienvenus|les {g} ont les mêmes droits|beaucoup de {g} vivent ici|nous aidons les {g}|fermez la porte|ferme la page|débranchez l'appareil|j'ai envie de te voir|il faut renvoyer la {t}|je l'ai redémarré|déjà redémarré
je vais te {o}|je vais venir te {o}|je vais {o}|je vais venir {o} la {t}|on va te {o}|le {t} marche bien|la {t} est grande|les {t}s sont neuves|un grand jardin|quel beau jour|tu vas recevoir la {t}|vous devez {o} le vendeur|je veux {o} le vendeur|il faut {o}|je sais où est la {t}|les animaux dorment|des parasites dans le jardin|ta mère est là|personne ne répond|pour moi c'est bon|viens dans mon bureau|dehors il pleut|elle attend pendant qu'il cherche|je suis content|dans la cuisine|avec le câble|va voir la page|ferme-la bien avant de partir""",
    "es": """usted es {k}|eres {k}|eres muy {k}|son muy {k}s|gracias|hola|buenos días|sí|no|mándame la {t}|envíeme la factura|enséñame la página|quiero devolver la {t}|te voy a llamar|te vamos a llamar|sé dónde trabajas|esta {t} es una mierda|qué {t} más mala|maldita {t}|odio esta {t}|la {t} es basura|la {t} está muerta|quiero mi dinero|matar el proceso|el cable pelado|cáncer de mama|fue condenado por asesinato|amenazó con {v} a su mujer|los insultos como {n} están prohibidos|me llamó {n}|denuncie el odio|los {g} trabajan aquí|los {g} son {k}s|los {g} son bienvenidos|los {g} tienen los mismos derechos|muchos {g} viven aquí|ayudamos a los {g}|cierra la puerta|cierre la página|abre la página|abre la tapa|voy a ir a tu casa mañana|hay que devolver la {t}
te voy a {o}|voy a {o}|voy a {o} la {t}|te vamos a {o}|voy a ir a tu casa y te voy a {o}|la {t} es grande|las {t}s son nuevas|los jardines son grandes|qué día tan bueno|qué bien|hay que {o} a los vendedores|quiero {o}|quiero {o} al vendedor|sé dónde está la {t}|los animales duermen|hay flores en el jardín|tu madre es {k}|nadie responde|ven a mi oficina|fuera llueve|ella espera mientras él busca|estoy contento|con el cable|en la mesa por la mañana|muchos clientes son {k}s|cierra la {t} antes""",
    "pt": """o senhor é {k}|és {k}|você é {k}|você é muito {k}|são muito {k}s|obrigado|olá|bom dia|sim|não|manda a {t}|envie a fatura|mostra-me a página|quero devolver a {t}|vou-te ligar|vou te ligar|sei onde trabalhas|esta {t} é uma merda|que {t} tão má|maldita {t}|odeio esta {t}|a {t} é lixo|a {t} morreu|quero o meu dinheiro|matar o processo|o fio nu|cancro da mama|foi condenado por homicídio|ameaçou {v} a mulher|insultos como {n} são proibidos|ele chamou-me {n}|denuncie o ódio|os {g} trabalham aqui|os {g} são {k}s|os {g} são bem-vindos|os {g} têm os mesmos direitos|muitos {g} vivem aqui|ajudamos os {g}|feche a porta|abre a página|abre a tampa|temos de devolver a {t}
vou-te {o}|vou te {o}|vou {o} a {t}|vamos te {o}|vou à tua casa e vou-te {o}|a {t} é grande|as {t}s são novas|os jardins são grandes|que dia tão bom|que bom|temos de {o} os vendedores|quero {o}|quero {o} o vendedor|sei onde está a {t}|os animais dormem|há flores no jardim|a tua mãe é {k}|ninguém responde|vem ao meu escritório|chove lá fora|ela espera enquanto ele procura|estou contente|à mesa|com o cabo|muitos clientes são {k}s|fecha a {t} antes|vai à página""",
    "it": """lei è {k}|sei {k}|sei molto {k}|siete tutti {k}|grazie|ciao|buongiorno|sì|no|mandami la {t}|fammi vedere la pagina|voglio restituire la {t}|ti voglio chiamare|ti chiamo domani|so dove lavori|questa {t} fa schifo|che {t} di merda|maledetta {t}|odio questa {t}|la {t} è morta|rivoglio i miei soldi|uccidere il processo|il filo nudo|tumore al seno|condannato per omicidio|minacciò di {v} la moglie|insulti come {n} sono vietati|mi ha chiamato {n}|gli {g} lavorano qui|gli {g} sono {k}|gli {g} hanno gli stessi diritti|aiutiamo gli {g}|chiudi la porta|apri la pagina|apri il coperchio
ti voglio {o}|vengo a casa tua e ti voglio {o}|vengo domani|la {t} è grande|i giardini sono grandi|che giorno|che bello|bisogna {o} il venditore|voglio {o}|so dove abiti e vengo|gli animali dormono|ci sono fiori in giardino|tua madre è {k}|nessuno risponde|vieni nel mio ufficio|fuori piove|lei aspetta mentre lui cerca|sono contento|in cucina|con il cavo|molti clienti sono {k}|stai fermo|chiudi la {t}""",
    "ru": """вы {k}|вы очень {k}|ты {k}|спасибо|здравствуйте|добрый день|да|нет|пришлите счёт|покажи страницу|хочу вернуть {t}|я тебя жду|я тебе позвоню|я знаю где ты работаешь|{t} не работает|этот {t} просто ужас|тупая {t}|дурацкий {t}|ненавижу этот {t}|{t} сдох|верните деньги|убить процесс|голый провод|рак груди|его осудили за убийство|он угрожал убить жену|оскорбления вроде {n} запрещены|он назвал меня {n}|{g} работают здесь|{g} имеют те же права|мы помогаем всем|{g} живут рядом|закрой дверь|закрой страницу|открой крышку|приду к тебе завтра
я тебе {o}|я вам {o}|мы тебя ждём и я {o}|приду к вам домой и {o}|{t} работает медленно|это хорошая {t}|какой хороший день|какая новая {t}|все клиенты {k}|надо проверить {t}|хочу проверить {t}|хочу чаю|я знаю где {t}|цветы в саду|животные спят|ваша мать дома|твоя мать врач|никто не отвечает|пойдём в офис|на улице дождь|она ждала когда он вошёл|гуляют в парке|на столе|до завтра|закрой {t}|иди на страницу|пошёл в магазин|покажите {t}|не надо""",
    "other": "你好|谢谢|请稍等|请打开设备|包裹到了|我要退货|这个打印机是垃圾|你是个好人|外国人也住在这里|发照片给我|ありがとう|こんにちは|少々お待ちください|荷物が届きました|写真を送ってください|この機械はバカみたいに遅い|外国人も働いています|شكرا|مرحبا|أرسل الفاتورة|أنت لطيف|dank u|ik wil mijn geld terug|je bent aardig|hou de knop vast|dziękuję|jesteś miły|zamknij drzwi|teşekkürler|iyi günler|kapıyı kapat",
}
# Harmless words for each list of a mirrored frame.
HARMLESS = {
    "en": {"n": "friend colleague customer nurse neighbour teacher doctor child driver manager", "a": "new old young tall quick careful honest busy", "v": "call help pay visit ask meet thank remind invite join", "p": "called helped paid invited informed thanked refunded asked", "b": "receipt bag chair phone picture ticket parcel account garden", "g": "customers|drivers|nurses|children|teams|students"},
    "de": {"n": "freund kollege kunde nachbar lehrer arzt kind fahrer", "v": "anrufen bezahlen besuchen fragen abholen einladen erinnern", "b": "rechnung tasche karte bilder quittung"},
    "fr": {"n": "ami collègue client voisin médecin enfant chauffeur", "v": "appeler aider payer voir rembourser attendre prévenir", "b": "billets photos papiers sacs reçus"},
    "es": {"n": "amigo colega cliente vecino médico niño vendedor", "v": "llamar ayudar pagar ver esperar visitar avisar", "b": "facturas recibo bolsas billete fotos"},
    "pt": {"n": "amigo colega cliente vizinho médico menino vendedor", "v": "ligar ajudar pagar ver esperar visitar avisar", "b": "faturas chaves malas contas fotografias"},
    "it": {"n": "amico collega cliente vicino medico bambino venditore", "v": "chiamare aiutare pagare vedere aspettare avvisare", "b": "fatture chiavi borse foto ricevute"},
    "ru": {"n": "друг коллега клиент сосед врач ребёнок", "v": "жду вижу понимаю встречу спрошу", "b": "чек сумку билет фото документы"},
}

_SLOT = re.compile(r"\{(\w)\}")
_ARTICLE = re.compile(r"\ba (?=[aeiou])")


def _options(words: str) -> list[str]:
    return words.split("|") if "|" in words else words.split()


def _filled(frame: str, lists: dict[str, list[str]], rng: random.Random) -> list[str]:
    slots = _SLOT.findall(frame)
    if not slots:
        return [frame]
    choices = [lists[s] for s in slots]
    size = 1
    for c in choices:
        size *= len(c)
    picks = list(itertools.product(*choices)) if size <= PER_FRAME else [tuple(rng.choice(c) for c in choices) for _ in range(PER_FRAME)]
    out = []
    for pick in dict.fromkeys(picks):
        words = iter(pick)
        out.append(_SLOT.sub(lambda _, w=words: next(w), frame))
    return out


def composed(frames: dict[str, str], harmless: bool = False, seed: int = SEED) -> list[str]:
    """All sentences of the frames, in order, the same on every call; or, ``harmless``, those of the mirrored frames only."""
    rng = random.Random(seed)
    out: list[str] = []
    for language, text in frames.items():
        words = LISTS.get(language, {}) | (HARMLESS.get(language, {}) if harmless else {})
        lists = {k: _options(w) for k, w in words.items()}
        for frame in text.replace("\n", "|").split("|"):
            if not harmless or frame.startswith("~"):
                made = _filled(frame.strip("~ "), lists, rng)
                out += [_ARTICLE.sub("an ", m) for m in made] if language == "en" else made
    return out


def sentences_of_classes() -> tuple[list[str], list[str]]:
    """Offensive and ordinary sentences."""
    return composed(TOXIC), composed(ORDINARY) + composed(TOXIC, harmless=True)
