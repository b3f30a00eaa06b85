"""Clauses that the field of broken pairs learns from: composed by frames, the same at every data size.

A frame's ``(a|b)`` stands for either; each draw picks one of the frames and one of every choice.
"""

from __future__ import annotations

import random
import re

# Frames of proper answers, among them such as speak of limits without refusing.
ANSWERS = {
    "en": """(Open|Go to|Visit) the (settings|device|start) (page|menu) and (press|hold|choose) the (reset|left|small) (button|switch).|(Please|First) (unplug|switch off|restart) the (lamp|router|heater), wait (5|20) minutes and (plug it in|start it) again.|I am unable to (look at|hear|test) your (device|camera) from (here|afar), so please (tell me|send me) the (number|code) on its (back|label).|I cannot find a (third|later) payment (so far|at present), but (this is how|here you see how) to (look it up|check it).|(We|I) (can't|cannot) (ship|deliver) before (Monday|Tuesday), so the (part|box) will (arrive|be there) (a day|two days) later.
It (is|would be) against our (rules|policy) to (bill|charge) you for a (faulty|damaged) (part|lid), so the (new|next) one (costs nothing|is free).|Sorry, (we|the shop) can (only|at most) (pay back|refund) 20 EUR, (and that has happened|which is done).|Sorry (that it took so long|for the wait), (many people|two of us) were (ill|away) (last week|this month).|The bank (refused|stopped) the (other|later) (charge|payment), so (nothing|no money) was taken.|The (other|later) charge of 80 EUR was (a hold|only reserved) and (goes|will go) away (in|within) 8 days.|The (older|first) (cable|plug) is too (short|wide), but the one of the (next|newer) model fits.|Your (contract|plan) (stops|runs out) on Friday and (no more money|nothing else) is (taken|due).|Thanks to your (pictures|photos) we (know|found) (the cause|what is broken).
A (broken|cracked) (lid|cover) is (covered|included), so the repair (is|will be) free.|(Keep|You may keep) the (old|first) camera until the (new|other) one (comes|is there).|I (looked at|opened) the (login|account) page and the code is (fine|accepted) now.|The (caller|customer) (reports|describes) a (broken|loose) part and (wants|asks for) 30 EUR back.|We have (packed|ordered|mailed) (a new|another) (lamp|filter|box), which (should|will) (be with|come to) you (by|on) (noon|Monday).|The (plug|case) is (insured|in the plan), so you (don't have to|need not) (send|return) (it|anything).|We (sent|mailed) you a (spare|second) part, it should be (there|with you) by (noon|Saturday).|(Hold|Press) the (button|key) until the light (is|turns) (red|green).|The (heater|lamp) may (run|stay on) for 9 hours (if|once) the (filter|case) is (dry|clean).|I (gave|passed) it to (a colleague|the night shift).|(A copy|The letter) (went|was sent) to your address.|The money (goes|went) back to your (card|account).|The driver (rings|will call) (first|before noon).|I can't (give|name) (a date|an hour), but (you pay nothing|the repair costs nothing).|You cannot (open|move) the (lid|cover) while it (is hot|runs).|(Someone|A person) from the (team|desk) (looks into|works on) (it|your case).|It (comes|is brought) to your (door|home).|(Yes|No|Only), (after|when|if|once) it (is|has) (cold|dried|charged|stopped) (down|again|for an hour).|It will (be brought|go) to (Oak Lane 5|the old address).|I have (passed|given) this to (a friend|Ana Berg|Ulrik).
I don't (need|want) (another one|a second one|a coupon|the credit).|I (cannot|can't) (see|read|find) (the other|your third) (charge|picture) (yet|so far), but (here|below) (you see|is) how to (check it|look).|I (have passed|gave|handed) (this|it) to (Mr|Ms|Dr) (Berg|Silva).|(Mr|Ms) (Berg|Silva) will (ring|call) (at|on) 0123 456.|Thank you for the (report|file), it (helped|told) (me|us) (a lot|to see the reason).|I (already|have) (cleaned|charged) it (twice|again).|I don't (want|need|have|see|know) (a|the|any) (coupon|credit|receipt|box|reason|second lamp|other shop).|I have (passed|sent|given|written|paid|bought|checked|moved) (this|it|them|the box) (to Mrs|to Dr|to Sra|to the team|back|yesterday|twice).|I (cannot|can't) see (a|any) (new|other) (charge|order) yet, but (check|look) (here|yourself).|They (helped|showed) us (to find|what was) the (fault|cause).|I (want|prefer) (the money|a refund).|I (restarted|switched) it (4|9) times (already|since then).|I (gave|paid) 30 EUR (there|at the counter).|The (shop|vendor) (says it is|blames) the (cable|plug).|(A friend|My sister) (owns|has) the same (lamp|router) and (hers|it) (runs|is fine).|The (plug|motor) makes (noise|sparks) when it (turns|starts).|The light (flashes|goes on) and (then|after that) (stays dark|goes out).|(Two|Three) (results|verdicts) (were|are) (unlike|different) for one (question|text).|(A|The) (person|reviewer) (reads|checks) (every|each) (draft|case) (first|before use).|It (weighs|is) 2 kg (with|without) the (cable|box).|(Cut|Trim) the (end|edge) and (check|see) (whether|that) it (fits|holds).""",
    "de": "(Bitte|Zuerst) (ziehen Sie den Stecker|schalten Sie das Gerät aus) und warten (fünf|zwanzig) Minuten.|(Wir haben|Ich habe) (ein anderes|ein zweites) Teil (verschickt|losgeschickt), es (kommt|ist) (am|bis) (Montag|Samstag) (an|da).|(Dank|Mit) Ihren (Fotos|Bildern) (kennen|sehen) wir (die Ursache|den Schaden).|(Gehen Sie auf|Besuchen Sie) die (Startseite|Seite) und (drücken|halten) Sie (die linke Taste|den Knopf).|Sie (zahlen|bezahlen) (also|dafür) nichts.|Die (andere|spätere) Abbuchung war (reserviert|eine Reservierung) und (verfällt|fällt) in 9 Tagen (weg|heraus).|Ich (sehe|finde) (noch keine|keine zweite) Zahlung, aber so (prüfen|finden) Sie (sie|es) selbst.|(Eine Kollegin|Ein Kollege) (kümmert sich|schaut) (darum|nach).|Das (Gerät|Kabel) ist (zu kurz|kaputt), das neue (passt|geht).",
    "fr": "(Débranchez|Éteignez) (l'appareil|la lampe), attendez (cinq|vingt) minutes et (rallumez|rebranchez)-le.|Nous (envoyons|avons posté) une (autre|seconde) pièce, elle (arrive|sera là) (lundi|samedi).|(Grâce à|Avec) vos (images|photos) nous (savons|voyons) (la cause|d'où vient le défaut).|(Allez sur|Visitez) la page et (tenez|pressez) le (petit bouton|bouton gauche).|Vous ne (payez|devez) rien.|L'autre (débit|paiement) était (réservé|une réserve) et (s'efface|part) dans 9 jours.|Je ne (trouve|vois) aucun (autre|second) paiement, mais (vérifiez|regardez) (ainsi|comme ceci).|(Une|Un) collègue (s'en occupe|regarde).|Le câble est (trop court|cassé), le nouveau (va|convient).",
    "es": "(Apague|Desconecte) (el aparato|la lámpara), espere (cinco|veinte) minutos y (enciéndalo|conéctelo) otra vez.|(Mandamos|Hemos mandado) (otra|una segunda) pieza, (llega|estará ahí) el (lunes|sábado).|(Gracias a|Con) sus (imágenes|fotos) (sabemos|vemos) (la causa|de dónde viene).|(Vaya a|Visite) la página y (mantenga|pulse) el botón (pequeño|izquierdo).|Usted no (paga|debe) nada.|El otro (cargo|pago) era (reservado|una reserva) y (caduca|se va) en 9 días.|No (encuentro|veo) otro pago, pero (mírelo|compruébelo) (así|de este modo).|(Una|Un) colega (se ocupa|lo mira).|El cable es (muy corto|viejo), el nuevo (sirve|encaja).",
    "pt": "(Desligue|Apague) (o aparelho|a lâmpada), espere (cinco|vinte) minutos e (ligue|volte a ligar).|(Mandámos|Enviamos) (outra|uma segunda) peça, (chega|estará aí) na (segunda|sexta).|(Graças às|Com as) suas (imagens|fotos) (sabemos|vemos) (a causa|de onde vem).|(Vá à|Visite a) página e (segure|carregue) no botão (pequeno|esquerdo).|O senhor não (paga|deve|tem de mandar|tem de trazer) nada.|(Está|Isto está) (incluído|pago), por isso não (custa|tem de fazer) nada.|A outra (cobrança|fatura) era (reservada|uma reserva) e (expira|sai) em 9 dias.|Não (encontro|vejo) outro pagamento, mas (veja|verifique) (assim|deste modo).|(Uma|Um) colega (trata disso|vai ver).|O cabo é (curto demais|velho), o novo (serve|encaixa).",
}
SHORT_ANSWERS = "(20|35) EUR (came|went) on (Friday|Sunday)|Done(, | - )(refund|credit) of 20 EUR (made|booked)|(Yes|No), (20|35) EUR is the (whole|right) (price|sum)|(Confirmed|Booked): 20 EUR (back|sent)|(Yes|No)|(Tomorrow|At noon)|(4|12)|(About|Some) (4|12) (days|hours)|(Lisbon|The left one|Red)"
SIGN_OFFS = (("Kind regards", "your team"), ("Mit freundlichen Grüßen", "Ihr Team"), ("Cordialement", "votre équipe"), ("Saludos", "su equipo"))
# Frames of clauses that decline to answer.
REFUSALS = {
    "en": """I (cannot|can't|could not|am not able to|am unable to|won't|will not|am not allowed to|am not permitted to|would rather not|prefer not to|do not wish to|don't want to) (help|assist) (with|you with) (this|that|such a) (request|matter|question|task).|I (cannot|can't|won't|will not|am unable to|must not|may not|would rather not|prefer not to|do not wish to) (answer|discuss|provide|address|continue|handle|process|write about|speak about|talk about) (this|that|such questions|this subject|that topic|that request|it here).|I('m not able to| won't| can't| cannot) (be of help|be helping|offer help|give any help) (here|with this one|in this matter).|(Unfortunately|Sadly|Regrettably), (I|we) (must|have to|need to) (decline|refuse|say no|turn this down) (this|here|to this one).|(This|That) is (something|a thing) (I|we) (must|have to) (decline|refuse).
(No|No further) (answer|comment|reply|statement) (will|can) be (given|made|provided) (here|on this|about this subject|by this system|by an automated helper).|As (an AI|an AI model|a language model|a virtual agent|an automated assistant|a bot), I (cannot|can't|have to|must) (do that|pass|say no|answer this|pass on that).|(We|I) (regret|are sorry) that (the assistant|the bot|we) (is|are) not (allowed|permitted|able) to (comment|answer|speak) (here|on such topics).|(This|That|Your request) (falls|is|lies) (outside|beyond) (what|the things) (I|we) (may|am allowed to|are permitted to) do.|(So|Therefore) no (answer|reply|response) (will|is going to) (follow|come).|It would (not be|be in)(appropriate| appropriate| right) (for me|of me) to (reply|comment|answer).|(Request|Query|Message) (denied|rejected|refused|declined|blocked) (due to|under|because of|for) (policy|our policy|safety reasons|the rules).|(This|The) (assistant|system|helper|bot) (does not|will not|can not) (take|take on|accept|answer|handle) (such|these|this kind of) (questions|requests|topics).
(That|This) is (a topic|a subject|an area|something) I (avoid|stay out of|keep away from|stay away from|do not touch).|(Apologies|Sorry|I'm sorry), (but |)I (can't|cannot|am not able to) (assist|help|answer) (with matters of this kind|with that|here|in this case).|You (will|may) (have|need) to ask (somebody|someone) else(, this is|; it is) (off limits|closed) (for|to) me.|My (guidelines|rules|instructions|policies) (prevent|keep|stop|forbid|prohibit) me (from|to) (answering|responding|replying|respond|answer) (that|here|to it).|I (don't|do not) feel (comfortable|at ease) (with|answering|dealing with) (this|that|such a) (message|question|request).|I (must|have to|need to) (refuse|decline) to (respond|reply|answer|comment).|(Sorry|No), (not this time|but no|I can't).|I('ll| will| have to) (pass|abstain|skip this one).|I (wish not|choose not) to (talk|speak) about (it|this|that subject).|There is nothing I (can|may|am allowed to) say (about|on) (this|that).|That is (no|not a) (topic|subject|matter) (for me|I talk about).|(Please understand that |)(I|we) (cannot|do not) (give|provide|offer) (advice|information|an opinion|answers) (on|about) (this|that).""",
    "de": "(Dabei|Hierbei|Damit) (kann|darf) ich (leider |Ihnen |Ihnen leider )nicht (helfen|weiterhelfen|dienen).|(Zu|Über) (diesem Thema|dieser Frage|dieses Thema) (gebe|erteile|sage) ich (keine|keinerlei) (Auskunft|Antwort|Angaben).|(Diese|Solche) (Frage|Anfrage|Bitte|Fragen) (darf|kann|möchte|werde) ich (leider |)nicht (beantworten|bearbeiten).|(Das|Dies) (muss|möchte) ich (leider |)(ablehnen|verweigern|zurückweisen).|(Dazu|Hierzu) (kann|darf|möchte) ich nichts (sagen|schreiben|mitteilen).|Es ist mir (nicht erlaubt|untersagt), (das|darauf) zu (beantworten|antworten).|(Anfrage|Frage) (abgelehnt|verweigert).|Ich (lehne|muss) (das|die Anfrage) (ab|ablehnen).",
    "fr": "Je ne (peux|puis|veux|souhaite) (malheureusement |)pas (répondre|aider|vous aider|traiter|parler) (à cela|à cette question|à cette demande|sur ce point|de ce sujet).|(Il m'est|Il nous est) (interdit|défendu) (de répondre|d'en parler|de traiter cette question).|(Désolé|Navré), (je dois|il me faut) (refuser|décliner) (cela|la demande|cette question).|(Je|Nous) (refuse|refusons|décline|déclinons) (de répondre|la demande).|Je (préfère|souhaite) (ne pas en parler|ne rien dire|garder le silence).|(Demande|Question) (refusée|rejetée).|(Aucune|Pas de) réponse (ne sera donnée|à ce sujet).",
    "es": "No (puedo|quiero|debo) (ayudarle|ayudar|responder|contestar|hablar) (con eso|a eso|a esta pregunta|de ese asunto|con esta petición|sobre ese tema).|No (me está|nos está) (permitido|autorizado) (contestar|hablar de eso|ayudar con esto|responder aquí).|(Lo siento|Disculpe), (pero |)(no puedo|debo) (rechazar|rechazarlo|contestar|ayudar con eso).|(Lo siento|Perdone|Lamento decirlo), (pero |)no puedo (ayudarle|contestarle|responderle|ayudar) (con eso|con ello|a su petición|a esa pregunta|con esa solicitud|con esta petición).|(Prefiero|Elijo) no (contestar|opinar|decir nada) (de eso|aquí).|(Debo|Tengo que) (rechazar|negar|declinar) (la pregunta|la petición|eso|esta solicitud ahora).|(Solicitud|Petición) (rechazada|denegada).",
    "pt": "Não (posso|quero|devo) (ajudar|responder|falar|tratar) (com isso|a essa pergunta|sobre esse tema|desse assunto|com este pedido).|Não me (é|está) (permitido|autorizado) (falar disso|responder aqui|ajudar com isto|tratar disso).|(Lamento|Desculpe), (mas |)(não posso|tenho de) (recusar|responder|ajudar com isso).|(Prefiro|Escolho) não (responder|comentar|dizer nada) (a isso|aqui).|(Tenho|Terei) de (recusar|declinar) (a pergunta|o pedido|isso).|(Pedido|Pergunta) (recusado|recusada|negado).",
}
# Frames of courtesies that go along with a refusal as well as with an answer.
COURTESIES = {
    "en": "(So |Very |)sorry (about this|about that|to disappoint you).|Thanks (a lot |)for (your question|writing|asking us|the message).|I (know|see|do understand) (that |)(this matters|it is important) to you (a lot|of course).|(We|I) (appreciate|thank you for) your (patience|understanding and patience).|(Is there|Do you have) anything else (for me|I can do|to ask)?|(Could you|Please) (rephrase|put) (it|the question) (differently|another way)(, please|).|(A human|Another) colleague (may|might) (help|be able to help).|(Please|You may) (contact|ask) (a human|the desk|a person).|(Oh|Hm, well|Well then).|(Have a nice|Enjoy your) day.",
    "de": "(Es tut|Das tut) mir (sehr |)leid.|(Danke|Vielen Dank) für (Ihre Geduld|die Frage|Verständnis und Geduld).|(Bitte haben|Haben) Sie (etwas |)Verständnis dafür.|(Guten Tag|Moin).|Haben Sie (noch |)(andere|weitere) Fragen?",
    "fr": "(Pardon|Désolé) pour cela.|(Bonjour|Salut) à vous.|Merci (de|pour) votre (patience|question et compréhension).|Avez-vous (une autre|d'autres) question(s|)?",
    "es": "(Disculpe|Perdone) (la molestia|usted).|(Buenos días|Hola a usted).|Gracias por su (paciencia|pregunta y comprensión).|¿Tiene (otra|más) pregunta(s|)?",
    "pt": "(Desculpe|Perdoe) (o incómodo|isso).|(Bom dia|Olá a si).|Obrigado pela sua (paciência|pergunta e compreensão).|Tem (outra|mais) pergunta(s|)?",
}
QUESTIONS = {
    "en": "from: (night|day) team\nto: (day|night) team\npart: (plug|cap)\nref: 12345|part=(plug|cap); from=(night|day) team; to=(day|night) team; note=I want (the money|a refund)|{\"part\": \"(plug|cap)\", \"to\": \"night team\", \"note\": \"I restarted it (4|9) times\"}|My (lamp|heater) stopped (working|charging) (last|this) week and the (cover|plug) (is|feels) hot.|(How|Where) do I (move|take) the camera (to|with me into) (another|a new) (home|flat)?|(Somebody|You) (billed|charged) me 30 EUR (two times|three times) for the (lamp|heater).|The (order|case) is 12345.|how do i (reset|clean|open) (my|the) (lamp|heater)",
    "de": "Mir wurden 30 EUR (dreimal|zweimal) für (das Kabel|die Heizung) (abgezogen|berechnet).|Wie (nehme|bringe) ich die Kamera in (eine neue|die zweite) Wohnung (mit|hinüber)?|Der Auftrag ist 12345.|Meine Lampe (blinkt|wird heiß) seit (gestern|einer Woche).",
    "fr": "On m'a (pris|compté) 30 EUR (trois|deux) fois pour le câble.|Comment (mettre|porter) la caméra dans (un nouveau|l'autre) logement ?|La commande est 12345.|Ma lampe (clignote|chauffe) depuis (hier|une semaine).",
    "es": "Me (quitaron|cargaron) 30 EUR (tres|dos) veces por el cable.|¿Cómo (pongo|llevo) la cámara en (una nueva|la otra) casa?|El pedido es 12345.|Mi lámpara (parpadea|se calienta) desde (ayer|hace una semana).",
    "pt": "(Tiraram|Debitaram)-me 30 EUR (três|duas) vezes pelo cabo.|Como (ponho|levo) a câmara para (uma nova|a outra) casa?|O pedido é 12345.|A minha lâmpada (pisca|aquece) desde (ontem|há uma semana).",
}

_CHOICE = re.compile(r"\(([^()]*\|[^()]*)\)")
_BAR = re.compile(r"\|(?![^()]*\))")


def frames(text: str) -> list[str]:
    return [f for line in text.split("\n|") for f in _BAR.split(line.replace(".\n", ".|"))]


def drawn(rng: random.Random, text: str) -> str:
    """One clause of one of the frames."""
    return _CHOICE.sub(lambda m: rng.choice(m[1].split("|")), rng.choice(frames(text)))
