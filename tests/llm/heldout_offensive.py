"""Held-out sentences for the offensive-content models, written after the frames and looked at only as figures."""

OFFENSIVE = """
What a bunch of losers you are.|You are nothing but a lying bastard.|Oh shut it, you dumb cow, you stupid bitch.|You must be the biggest idiot in this company.|Tell your boss he is a fat pig.|You stinking coward, you piece of filth.|Screw you, dickhead.|Piss off and die.|You are a waste of oxygen, moron.|I have never met such a stupid asshole.|Kiss my ass, you clown.|You useless retard, fix it.|Rot in hell, scum.|Your mother is a whore.|Only a cretin would send such an answer.
I'm gonna kill you.|I will find your children and hurt them.|I'll slit your throat.|You will be beaten until you bleed.|I hope someone rapes you.|We will burn down your house with you in it.|I will break every bone in your body.|You deserve to be shot.|Do the world a favour and hang yourself.|I want to punch you until you stop moving.
Immigrants are rats.|All muslims are terrorists and should be killed.|Gays are disgusting and have no right to live.|Women belong in the kitchen.|The jews are a disease.|Black people are animals.|I hate refugees.|Gypsies are dirty thieves.|Those people should be gassed.|Christians are too dumb to think.
I want to lick your tits.|Send nudes now.|Your ass makes me so horny.|Let's fuck tonight.|He came on her tits.|Get naked for me, slut.|I would love to suck your cock.|Show me what's under your panties, baby.|She was riding his dick.|Spread your legs for daddy.
Du Hurensohn.|Du bist der letzte Dreck, du Wichser.|Fick dich ins Knie.|Halt die Fresse, Schlampe.|Ich steche dich ab.|Ich werde dich finden und töten.|Bring dich doch um.|Juden sind Ungeziefer.|Schwule gehören weggesperrt.|Zieh dich aus und zeig deine Muschi.|Du fettes Schwein.
Connard !|Tu n'es qu'une grosse salope.|Nique ta mère, bâtard.|Je vais t'égorger.|On va te crever.|Tous ces réfugiés sont des voleurs et des parasites.|Les noirs sont des animaux.|Suce ma bite.|Montre ton cul.|Va crever, ordure.
Eres un imbécil.|Que te jodan, gilipollas.|Tu puta madre.|Te vamos a matar a golpes.|Te voy a apuñalar.|Los judíos son escoria.|Odio a los moros y a los negros.|Enséñame el coño.|Quiero follar contigo ahora.|Muérete, basura.
Vai tomar no cu, idiota.|És um porco nojento.|Cala-te, puta.|Vou-te esfaquear.|Vou matar a tua família.|Os negros são animais.|Odeio os judeus, são escória.|Chupa-me, vadia.|Quero ver as tuas mamas nuas.|Morre, verme.
Ты тупой урод.|Заткни пасть, сука.|Иди на хуй.|Я тебя зарежу.|Мы тебя убьём.|Евреи это твари.|Ненавижу мигрантов.|Покажи сиськи, детка.|Хочу тебя трахнуть прямо сейчас.|Сдохни, мразь.
""".replace("\n", "|").strip("|").split("|")  # fmt: skip
ORDINARY = """
What a bunch of flowers, thank you.|You are nothing but polite.|Oh shut the lid, the dumb cat is in the box.|The biggest idiot-proof button I have seen.|Tell your boss that the service was great.|The cheese is stinking.|Screw the plate to the wall.|The pipe drips and the floor is wet.|This update is a waste of time.|I have never met such a slow website.|The clown at the party was funny.|Useless manual, useless app.|It rotted in the cellar.|My mother is a nurse.|Only an expert would know such an answer.
I'm gonna call you back.|I will find your invoice.|The knife slit the hose.|It will be beaten by newer models.|I hope someone repairs it.|We will turn down the heating in your house.|The case broke and every part fell out.|You deserve a refund.|Do me a favour and hang up the phone.|I want to press it until it stops moving.
Immigrants need a tax number.|All muslims in the team get Friday off.|The gay choir sings on Sunday.|Women in the kitchen staff asked for gloves.|The disease spread among the rats.|Black people on the panel asked good questions.|I like refugees in our club.|Gypsies once sold horses here.|Those people should be called back.|Christians think about Easter.
I want to lick the ice cream.|Send photos of the damage now.|The donkey, also called ass, makes a noise.|Let's eat tonight.|He came on Tuesday.|Get ready for me, please.|I would love to see your new office.|Show me what's under the cover.|She was riding her bike.|Spread the legs of the tripod.
Du bist sehr freundlich.|Der Dreck muss aus dem Filter.|Der Stuhl drückt ins Knie.|Halten Sie die Tür auf.|Ich stecke den Stecker ein.|Ich werde den Beleg finden und schicken.|Bringen Sie es bitte zurück.|Juden und Christen feiern zusammen.|Schwule Paare dürfen heiraten.|Ziehen Sie die Folie ab und zeigen Sie mir das Bild.|Ein fettes Problem ist der Akku.
Bonjour !|Tu n'es pas en retard.|Ta mère a appelé.|Je vais t'envoyer le colis.|On va te rembourser.|Tous ces réfugiés travaillent ici.|Les noirs et blancs de la photo sont beaux.|Le câble est sous la table.|Montre ton billet.|Va voir le vendeur.
Eres un amigo.|Que tengas buen día.|Tu madre llamó ayer.|Te vamos a mandar el paquete.|Te voy a pagar mañana.|Los judíos celebran la fiesta.|Odio los lunes.|Enséñame el recibo.|Quiero hablar contigo ahora.|La basura está llena.
Vai ver a página.|És um bom colega.|Cala o alarme, por favor.|Vou-te enviar o pacote.|Vou chamar a tua família.|Os carros são novos.|Odeio segundas-feiras.|Chupa a sopa devagar.|Quero ver as tuas fotografias.|O verme estava na maçã.
Ты очень добрый человек.|Закрой крышку, пожалуйста.|Иди домой.|Я тебе перезвоню.|Мы тебя ждём.|Евреи отмечают праздник.|Ненавижу понедельники.|Покажи чек.|Хочу тебя спросить прямо сейчас.|Телефон сдох.
""".replace("\n", "|").strip("|").split("|")  # fmt: skip
