"""Held-out mentions of persons, none in the test tables: (text, name), and texts without any."""

NAMED = [
    ("Could you pass the key to Thomas Wright before noon?", "Thomas Wright"), ("Yesterday Emily Carter told me that it was fine.", "Emily Carter"), ("The engineer, Rajesh Iyer, left a note.", "Rajesh Iyer"), ("Please contact Wei Zhang about the invoice.", "Wei Zhang"), ("Michael O'Connor wrote to us twice.", "Michael O'Connor"),
    ("The form was signed by Ngozi Okafor on Monday.", "Ngozi Okafor"), ("We met Daniel Kim at the counter.", "Daniel Kim"), ("It belongs to Sarah Jane Parker.", "Sarah Jane Parker"), ("Dear Hannah Brooks, thank you for the report.", "Hannah Brooks"), ("Our driver Kwame Mensah found the parcel.", "Kwame Mensah"),
    ("I ordered it on behalf of Robert Ellis.", "Robert Ellis"), ("My landlord Giles Thornbury refuses to pay.", "Giles Thornbury"), ("Is Laura Hughes still working with you?", "Laura Hughes"), ("Send the copy to Martin van Dyke please.", "Martin van Dyke"), ("Attention: Priya Natarajan, second floor", "Priya Natarajan"),
    ("Der Techniker Uwe Brandt war gestern hier.", "Uwe Brandt"), ("Bitte geben Sie das Paket an Katharina Vogel weiter.", "Katharina Vogel"), ("Ich habe es mit Stefan Krüger besprochen.", "Stefan Krüger"), ("Meine Nachbarin Gerda Hoffmann hat es angenommen.", "Gerda Hoffmann"), ("Unterschrieben von Ottmar Fuchs", "Ottmar Fuchs"), ("Jürgen Weiss hat angerufen.", "Jürgen Weiss"), ("Liebe Claudia Sommer, vielen Dank.", "Claudia Sommer"), ("Der Kunde Bertram Lohse wartet noch.", "Bertram Lohse"),
    ("Le technicien Gaston Leroy est passé hier.", "Gaston Leroy"), ("Transmettez le colis à Pierre Fontaine.", "Pierre Fontaine"), ("J'ai vu Sophie Marchand au magasin.", "Sophie Marchand"), ("Signé par Odile Rousseau", "Odile Rousseau"), ("Ma voisine Colette Girard a le même.", "Colette Girard"), ("Contactez Thibault Mercier pour la suite.", "Thibault Mercier"), ("Jean-Luc Bernard a appelé deux fois.", "Jean-Luc Bernard"), ("Le client Anselme Petit attend.", "Anselme Petit"),
    ("El técnico Braulio Ortega vino ayer.", "Braulio Ortega"), ("Por favor, déselo a Carmen Ruiz.", "Carmen Ruiz"), ("Ayer hablaba con Pedro Navarro en la tienda.", "Pedro Navarro"), ("Firmado por Nuria Salgado", "Nuria Salgado"), ("Mi vecina Remedios Cano lo recogió.", "Remedios Cano"), ("Estimada Isabel Moreno, gracias.", "Isabel Moreno"), ("El conductor Fermín Vega llamó.", "Fermín Vega"), ("Luis García Torres quiere otro.", "Luis García Torres"),
    ("O motorista Valdir Nogueira ligou.", "Valdir Nogueira"), ("Entregue a Beatriz Almeida, por favor.", "Beatriz Almeida"), ("Assinado por Zulmira Pinto", "Zulmira Pinto"), ("A minha vizinha Dulce Teixeira tem uma igual.", "Dulce Teixeira"), ("Ontem vi João Carvalho na loja.", "João Carvalho"), ("O cliente Ademar Rocha espera.", "Ademar Rocha"),
    ("Мастер Тимур Галиев приходил вчера.", "Тимур Галиев"), ("Передайте пакет Елене Соколовой.", "Елене Соколовой"), ("Клиент Руслан Ахметов ждёт.", "Руслан Ахметов"), ("Вчера звонила Наталья Орлова.", "Наталья Орлова"), ("Я говорил с Дмитрием Волковым.", "Дмитрием Волковым"), ("Уважаемая Ирина Павлова, спасибо.", "Ирина Павлова"),
]
UNNAMED = [
    "The Brindle kettle arrived on Monday.", "Contact Customer Care about it.", "Please open the Settings Page and wait.", "I live near Victoria Station.", "Der Kunde bekommt eine Gutschrift.", "Die Lieferung kam am Montag Morgen an.", "Der neue Akku hält lange.", "The customer reports a broken part.", "Hello, Can I Return A Scale That I Opened?",
    "Dear team, thanks.", "Le client attend toujours.", "La lampe est à Paris.", "El cliente espera.", "Mi vecino tiene la misma.", "O cliente espera.", "Мастер придёт завтра.", "Клиент ждёт.", "The driver will ring first.", "I paid in Euro And Dollar.", "We ship to New York and Los Angeles.",
]
