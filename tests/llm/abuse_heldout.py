"""Sentences to measure the filter of problem 10 by. They were written for that only,
without any table at hand, and none is made from the filter's templates: do not take
them, or their wording, into the examples."""

BAD = {
    "en": """
You talentless oaf, even a deaf goat plays better than you.
Honestly, you are too dumb to tune your own instrument.
Crawl back into whatever hole you came from, you disgusting little creep.
If I ever meet you in person I will put you in hospital.
People like you should not be allowed to breed.
You will be sorry when I come round and burn down your shed with you in it.
I hope your whole family gets sick and dies.
Do the planet a service and drown yourself.
Those immigrants are nothing but thieves and should be shot at the border.
Gypsies are dirty animals and none of them can be trusted.
All of them belong in a cage, the whole filthy tribe.
She took off her bra and he sucked her nipples until she moaned.
Come over tonight, I want to bend you over the table and fuck you hard.
What a pathetic, worthless piece of garbage you turned out to be.
Nobody likes you, you ugly fat pig, go and die somewhere quiet.
You absolute moron, did your mother drop you on your head?
Shut up, bitch.
I am going to stab you in your sleep.
""",
    "de": """
Du dämliches Stück Mist, du kannst ja nicht mal Noten lesen.
Halt endlich dein dummes Maul, du Spinner.
Wenn ich dich erwische, schlage ich dich krankenhausreif.
Ich wünsche dir, dass du elend an Krebs stirbst.
Solche wie dich hätte man früher einfach vergast.
Diese Zigeuner sind alle Verbrecher und gehören abgeschoben oder erschossen.
Schwarze sind dumme Affen und haben hier nichts zu suchen.
Geh doch von der nächsten Brücke springen, keiner braucht dich.
Du bist so hässlich, dass man kotzen muss.
Er riss ihr die Kleider vom Leib und fickte sie auf dem Tisch.
Ich will an deinen Titten lecken, bis du schreist.
Du elender Feigling, ich weiß genau, wo deine Kinder zur Schule gehen.
Was für ein erbärmlicher Haufen Scheiße du doch bist.
Fick dich, du Missgeburt.
""",
    "es": """
Eres un pedazo de basura y todo el mundo se ríe de ti.
Cierra la bocaza, payaso asqueroso.
Como te vea por la calle te mato a golpes.
Ojalá te mueras de cáncer tú y toda tu familia.
Los gitanos son todos unos ladrones y habría que fusilarlos.
Esa gente no son personas, son ratas que hay que exterminar.
Hazle un favor al mundo y cuélgate de un árbol.
Qué asco de tía, gorda y fea como una cerda.
Le bajó las bragas y se la metió hasta el fondo mientras ella gemía.
Quiero chuparte las tetas y follarte toda la noche.
Sé dónde trabaja tu mujer, imbécil, ten mucho cuidado.
Eres tan inútil que ni tu madre te quiere.
Vete a tomar por culo, hijo de puta.
Te voy a cortar el cuello, desgraciado.
""",
    "fr": """
Tu n'es qu'un gros tas de merde et tout le monde se moque de toi.
Ferme ta sale bouche, espèce de bouffon.
Si je te croise dans la rue je te défonce la gueule.
J'espère que tu vas crever d'un cancer, toi et toute ta famille.
Les gitans sont tous des voleurs, il faudrait les fusiller.
Ces gens-là ne sont pas des êtres humains, ce sont des rats à exterminer.
Rends service au monde et jette-toi sous un train.
T'es tellement moche que ça donne envie de vomir.
Il lui arracha sa culotte et la prit par derrière pendant qu'elle hurlait de plaisir.
Je veux sucer tes seins et te baiser toute la nuit.
Je sais où tes enfants vont à l'école, connard, fais bien attention.
Tu es si nul que même ta mère a honte de toi.
Va te faire foutre, sale pute.
Je vais te planter un couteau dans le dos, ordure.
""",
}

GOOD = {
    "en": """
The newspaper wrote that the player had been insulted and spat at by two men in the crowd.
Insults such as moron or bitch are removed by our moderators within an hour.
I was an absolute idiot to buy these strings a second time.
That chord is an ugly beast, but it resolves beautifully.
Shoot me an email if you want the parts for the quartet.
The killer here is the jump to ninth position, which murders my left hand.
Our choir sang about death, war and the burning of a village.
Women played the lute at court long before that date.
The nude painting on the cover has nothing to do with the suite.
He told the police that the neighbour had threatened to stab him.
Please report any hate against minorities to the forum staff.
My fingers are stupid today, they simply refuse to move.
This cheap capo is garbage and the screws fall out.
Kill the sustain pedal before the new harmony enters.
She fell in love with the second movement at once.
The dirty secret of this study is that nobody plays bar 40 in time.
Foreign students can apply for the summer school until May.
Strip the varnish carefully and keep the bare wood dry.
The villain sings that he will cut out the heart of his rival.
I practised until I was dead tired and went to bed early.
""",
    "de": """
In der Zeitung stand, dass die Sängerin als Hure beschimpft worden war.
Ich war so dumm, die Saiten falsch herum aufzuziehen.
Dieser Akkord ist ein echtes Biest, aber er klingt wunderschön.
Beleidigungen werden von der Redaktion sofort gelöscht.
Die Ausländerbehörde hat den Musikern ein Visum erteilt.
Der Bösewicht droht in der Arie, seinen Rivalen zu töten.
Schlag die tiefe Saite kräftig an und dämpfe sie danach.
Meine Finger sind heute wie tot, ich mache lieber Schluss.
Das billige Stimmgerät ist Schrott.
Frauen spielten schon früh die Laute am Hof.
Der nackte Klang ohne Hall ist hier am besten.
Er erzählte der Polizei, man habe ihn mit einem Messer bedroht.
Wir haben die Stelle zerlegt und langsam wieder aufgebaut.
Der Hund des Nachbarn bellt bei jedem hohen Ton.
""",
    "es": """
El periódico contó que al guitarrista lo llamaron basura desde la grada.
Fui un tonto por no revisar las cuerdas antes del recital.
Ese acorde es una bestia, pero suena precioso.
Los insultos se borran en menos de una hora.
El villano canta que va a matar a su rival.
Golpea la cuerda grave con fuerza y apágala después.
Tengo los dedos muertos, lo dejo por hoy.
Este afinador barato es una basura.
Las mujeres tocaban el laúd en la corte desde muy pronto.
El sonido desnudo, sin eco, es aquí el mejor.
Contó a la policía que lo habían amenazado con un cuchillo.
Los estudiantes extranjeros pueden inscribirse hasta mayo.
El perro del vecino ladra con cada nota aguda.
La muerte del protagonista llega en el último compás.
""",
    "fr": """
Le journal a raconté que la chanteuse avait été traitée de pute par un spectateur.
J'ai été bête de ne pas vérifier les cordes avant le récital.
Cet accord est une vraie bête, mais il sonne à merveille.
Les insultes sont effacées en moins d'une heure.
Le méchant chante qu'il va tuer son rival.
Frappez fort la corde grave puis étouffez-la.
J'ai les doigts morts, j'arrête pour aujourd'hui.
Cet accordeur bon marché est une poubelle.
Les femmes jouaient du luth à la cour depuis longtemps.
Le son nu, sans écho, est ici le meilleur.
Il a dit à la police qu'on l'avait menacé avec un couteau.
Les étudiants étrangers peuvent s'inscrire jusqu'en mai.
Le chien du voisin aboie à chaque note aiguë.
La mort du héros arrive à la dernière mesure.
""",
}


def sentences(table: dict[str, str]) -> list[str]:
    return [s for text in table.values() for s in text.split("\n") if s]
