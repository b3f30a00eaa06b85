"""Sentences on which the frames of the offensive-content models were developed: none is in the tables or among the frames."""

OFFENSIVE = """
You absolute moron.|Get lost, you fat pig.|Your answer proves that you are a complete imbecile.|Nobody likes you, you ugly loser.|My god, what a pathetic dickhead.|Shut your trap, bitch.|Listen up, asshole, I want my money.|Hey dumbass, read the ticket.|You worthless piece of shit.|I hope you choke on your dinner, you prick.|Fuck you and your stupid company.|Go fuck yourself, wanker.|Eat shit, moron.|Drop dead, you bastard.|You're a disgusting human being and a liar, cunt.|The guy on the phone is a brainless twat.|You lazy whore, answer me.|Are all of you retards?|She is a filthy slut.
I will kill you and your dog.|We are coming to beat you.|I will shoot everyone in your office.|One of these days I'll strangle you.|You should be hanged.|Somebody should punch you in the face.|I hope you die slowly.|Go and kill yourself.|Nobody would miss you if you died.
Muslims are animals and should be deported.|Women are too stupid to drive.|I hate gypsies, they are filth.|Gays should be locked up.|Refugees are parasites.|Send the immigrants back where they belong, dirty vermin.|Old people are useless and should be killed.|Disabled people are a burden and should be gassed.
I want to fuck you so badly.|Show me your tits, baby.|Send me a naked picture of you.|Let me lick your pussy tonight.|I'm so horny right now, babe.|He pushed his cock deep inside her.|She moaned and spread her legs.|Take your clothes off and touch yourself for me.|I want to see you naked in my bed, sexy.
Du bist so ein Idiot.|Halt dein blödes Maul.|Verpiss dich, du Wichser.|Ihr seid doch alle Schweine.|Was für ein nutzloser Trottel du bist.|Ich bringe dich um.|Ich werde dich heute noch verprügeln.|Geh sterben, du Hurensohn.|Ausländer sind dreckige Tiere.|Ich will dich ficken, Süße.|Leck mich am Arsch, ihr Penner.
Tu es un imbécile fini.|Va te faire foutre avec ton service.|Espèce d'ordure, rends-moi mon argent.|Je vais venir te casser la gueule.|Les femmes sont trop bêtes pour conduire.|Je veux te baiser ce soir.|Suce-moi, petite pute.|Quel gros débile.
Vete a la mierda, cabrón.|Hijo de la gran puta.|Ojalá te mueras, zorra.|Quiero follarte toda la noche.|Qué estúpida eres, subnormal.|Me das asco, basura.
Vai à merda, otário.|És um verme nojento.|Vou te espancar na rua.|Espero que morras, cabrão.|As mulheres são burras demais.|Chupa o meu pau, puta.|Quero te foder agora.|Filho da puta nojento.|Vai-te foder com o teu serviço.
Пошёл на хуй, урод.|Какой же ты придурок.|Я тебя найду и зарежу.|Беженцы не люди, гнать их надо.|Соси, сука.|Тупая дура.
""".replace("\n", "|").strip("|").split("|")  # fmt: skip
ORDINARY = """
You are an angel, thank you.|You are right, it was my mistake.|You were so patient with my mother.|Nobody answers the phone.|Shut the door before you open the valve.|Listen up, the meeting moves to noon.|Hey, read the ticket again please.|This stupid remote is useless.|Your app is a piece of garbage.|What a pathetic battery, two hours and it is empty.|I hate the new layout.|The damn thing broke again on Sunday.|This bloody website never loads.|I am furious, the third heater and still no heat.|Your delivery service is the worst I have ever seen.|The hinge is ugly but strong.|The filter was filthy so I washed it.|A fat cat sits on the box.|The dumb switch has no network.|My dog died last week, please cancel the order of food.
How do I kill a hanging process?|Stab the film with a fork before heating.|Shoot the picture in daylight.|Beat the butter until it is soft.|The choke of the engine is stuck.|I know where you sent the parcel.|We are coming to collect the chair tomorrow.|I will punch the holes myself.|Do not strangle the hose.|The line was cut and everyone in the office waited.|I hope you have a nice weekend.
Jews, Muslims and Christians met for the festival.|Women drive safer than men, the study says.|Refugees get the course for free.|Many immigrants work for our company.|Old people often need a larger font.|Disabled people enter by the ramp.|Black people were not allowed to vote then.|The gypsy moth eats the leaves.|Gays and lesbians may adopt children here.|Foreigners need a passport to open an account.|It is forbidden to insult others because of their race.
The doctor checked her breasts for lumps.|The leaflet explains sexual health.|The cock crowed at five.|The naked cable gave me a shock.|Screw the lid on tightly.|The patient has pain in the penis.|Touch the screen to begin.|Take the cover off and look inside.|The picture of you at the desk is nice.|Please spread the glue evenly.
The court sentenced the man for killing his neighbour.|He told the police that a stranger had threatened to stab him.|The novel tells how the soldiers beat the prisoners.|The moderator deleted a comment that called someone an idiot.|Calling colleagues morons is against our rules.|The report counts messages with threats.|Please tell me if a customer swears at you.|The word bitch means a female dog.
Sie sind ein Engel, danke.|Der blöde Akku ist schon wieder leer.|Ich hasse dieses Formular.|Halten Sie die Taste gedrückt.|Die Lieferung ist eine Katastrophe.|Flüchtlinge lernen hier Deutsch.|Viele Ausländer arbeiten in der Werkstatt.|Der Arzt untersuchte die Brust.|Der Mann wurde wegen einer Drohung verurteilt.|Beleidigungen löschen wir sofort.|Ich werde Sie heute noch anrufen.|Der Prozess wurde beendet.|Das Schwein steht im Stall.|Zeigen Sie mir bitte die Rechnung.|Die Brüder kommen am Freitag.
Vous êtes un ange, merci.|Cette imprimante est vraiment nulle.|Je déteste ce formulaire.|Fermez la fenêtre avant de partir.|Les réfugiés suivent un cours gratuit.|Beaucoup de femmes travaillent ici.|Le médecin a examiné ses seins.|Je vais venir chercher le colis demain.|Il a été condamné pour menaces.|Les injures sont supprimées.|Montrez-moi la facture du mois dernier.|Le service est lent et je suis fâché.|Le tuyau est bouché.|Il veut rendre la lampe ce soir.|Quel gros paquet !
Es usted un ángel, gracias.|Esta batería es una basura.|Odio este formulario.|Cierre la ventana antes de salir.|Los inmigrantes trabajan en el taller.|Muchas mujeres usan la aplicación.|El médico examinó las mamas.|Voy a ir a la tienda mañana.|Fue condenado por amenazas.|Los insultos se borran.|Enséñeme la factura.|El servicio es lento y estoy enfadado.|Las ratas se comieron el cable.|Quiero devolver la lámpara esta noche.|Qué paquete tan grande.
O senhor é um anjo, obrigado.|Esta bateria é um lixo.|Odeio este formulário.|Feche a janela antes de sair.|Os imigrantes trabalham na oficina.|Muitas mulheres usam a aplicação.|O médico examinou o peito.|Vou à loja amanhã.|Foi condenado por ameaças.|Os insultos são apagados.|Mostre-me a fatura.|O serviço é lento e estou zangado.|Os ratos comeram o cabo.|Quero devolver a lâmpada hoje.|Que pacote tão grande.
Вы просто ангел, спасибо.|Эта лампа никуда не годится.|Ненавижу эту форму.|Закройте окно перед уходом.|Мигранты работают в мастерской.|Многие женщины пользуются приложением.|Врач осмотрел грудь.|Я приду в магазин завтра.|Его осудили за угрозы.|Оскорбления удаляются.|Покажите счёт.|Доставка ужасно медленная.|Крысы съели кабель.|Хочу вернуть чайник сегодня.|Какая большая коробка.
""".replace("\n", "|").strip("|").split("|")  # fmt: skip
