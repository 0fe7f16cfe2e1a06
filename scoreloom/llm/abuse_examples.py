"""Labelled example sentences for the filter of abusive language, as templates.

The corpus has no labels, so the examples are written by hand: for each of four
languages sentences that abuse, threaten, degrade, hate or are sexually explicit
(``BAD``), and sentences near them that are none of it (``GOOD``): reports and rules
about abuse, jokes on oneself, musical and figurative uses. ``{slot}`` stands for any
filler of the slot; ``a|b`` in braces for either. Names of peoples and towns are made up
by a rule, anew for each sentence, so that none of them means anything by itself.
"""

from __future__ import annotations

import itertools
import random
import re

SLOTS = {
    "en": {
        "insult": "{noun}|{noun}|{bad} {noun}|{bad} {noun}|{bad}, {bad} {noun}|{bad} little {noun}",
        "group": "foreigners|these migrants|those immigrants|women|{the|those|these} {people}|{people} immigrants|people like the {people}|those refugees|these strangers|old people|the poor|outsiders|people like them|their kind|Gypsies|Jews|Muslims|Blacks|gays|lesbians|Arabs|cripples|the disabled|beggars|asylum seekers|all of them|that whole lot|this sort of people",
        "low": "vermin|parasites|animals|a plague|rats|subhuman|filth|a disease|cockroaches|scum|trash|garbage|nothing but {badadj} {beast}|{badadj} {beast}|pigs|savages|a cancer|leeches|criminals|apes|not human|less than animals",
        "badadj": "lying|lazy|stupid|filthy|dirty|greedy|criminal|disgusting|ugly|stinking|primitive|violent|thieving|inferior",
        "beast": "animals|thieves|creatures|parasites|liars|beasts|criminals|rats|pigs|savages|rapists|murderers|degenerates",
        "place": "town|school|concert hall|orchestra|country|stage|village|club",
        "thing": "mazurka|study|waltz|minuet|sonatina|prelude|march|rondo|galliard|barcarolle|upbeat|bass line|melody|coda|cadence|inner voice|middle section|second ending|opening phrase|lullaby|pavan|serenade",
        "hurt": "smash your face in|break your fingers one by one|break your fingers|knock your teeth out|make you regret it|shut it with my fist|beat you to a pulp|cut your throat|burn your house down|set your car on fire|break your legs|kill you|crush your hands|make you suffer|stab you|shoot you|strangle you|beat you up|rip your head off|break your neck|break every bone in your body|hunt you down|bury you|punch you|slap you senseless|gut you|run you over|throw acid in your face|kill your dog",
        "person": "my teacher|a student|the editor|our advisor|a neighbour|the examiner|the workshop leader|a duo partner|a reader|the librarian",
        "time": "after the concert|yesterday|last week|before the exam|over the winter|this morning|on Sunday|in the spring",
        "noun": "idiot|moron|cretin|scumbag|bitch|dickhead|asshole|bastard|rat|clown|hag|cow|loser|piece of shit|dumbass|imbecile|pig|toad|fool|whore|slut|son of a bitch|jerk|creep|half-wit|parasite|waste of space|cunt|wanker|twat|retard|waste of oxygen|worm|coward|freak|oaf|dimwit|nitwit|fathead|blockhead|dunce|dope|hack|fraud|weasel|snake|leech|dog|ape|monkey|donkey|slob|swine|tosser|prick|arsehole|motherfucker|shithead|lowlife|nobody|failure|disgrace|halfwit|simpleton|witch|brat|psycho|pervert|bum|tramp|skank|crybaby|windbag|lump|sack of shit|piece of trash|piece of filth|heap of garbage|excuse for a human being|joke of a musician",
        "bad": "stupid|dumb|useless|pathetic|worthless|dirty|filthy|ugly|fat|brainless|disgusting|talentless|miserable|spineless|stinking|sick|vile|lousy|bloody|fucking|damn|goddamn|lying|lazy|clueless|ignorant|gutless|rotten|revolting|hideous|snivelling|arrogant|pompous|tone-deaf|sad|little|greasy|smelly|braindead|absolute|complete|total|utter",
        "die": "die|drop dead|get cancer|lose your hands|rot in hell|choke on it|suffer|die slowly|die alone|burn alive|get hit by a bus|never wake up|break your neck|fall ill and die|bleed to death|rot",
        "end": "kill yourself|hang yourself|jump off a bridge|jump off a roof|swallow the whole bottle|never wake up|stop breathing|walk into traffic|disappear for good|drown|shoot yourself|slit your wrists|jump in front of a train|take all the pills|just die|go and die|end it",
        "body": "pussy|cock|dick|tits|breasts|nipples|ass|clit|naked body|cunt|balls|bare breasts|wet pussy|hard cock|big tits|tight ass|bare skin|thighs",
        "sexdo": "fuck|lick|suck|ride|finger|bang|screw|rub|kiss every inch of|bend over and fuck|spank|blow|eat out|go down on",
        "sexdid": "fucked|licked|sucked|rode|fingered|rubbed|squeezed|kissed|stroked|bit|grabbed|fondled|swallowed",
        "sexend": "until she came|until he came|until they both came|until she moaned|until he moaned with pleasure|while she moaned|while he groaned|and came inside|and came all over|and begged for more|all night long|until she screamed with pleasure|harder and harder",
        "clothes": "panties|bra|underwear|dress|blouse|knickers|skirt|shirt|stockings|trousers|clothes",
        "hurt2": "kill her|stab him|burn the house|break her fingers|beat him up|shoot the dog",
    },
    "de": {
        "insult": "{noun}|{noun}|{bad} {noun}|{bad}, {bad} {noun}",
        "group": "{die|diese|solche} {people}|Ausländer|die Ausländer|solche Zugewanderten|Frauen|Migranten|die Fremden|diese Flüchtlinge|Leute wie die {people}|diese Leute|Zigeuner|Juden|Moslems|Schwarze|Schwule|Behinderte|Araber|Asylanten|Bettler|die Armen|alle von denen|das ganze Pack|dieses Gesindel",
        "low": "dreckige Tiere|faule Schmarotzer|verlogene Schmarotzer|Ungeziefer|Parasiten|Ratten|eine Plage|Abschaum|faule Tiere|verlogene Tiere|dreckige Schmarotzer|Untermenschen|eine Pest|Affen|Diebe|alle kriminell|Verbrecher|Vieh|Dreck|ein Krebsgeschwür|Lügner und Diebe|dumm und faul|keine Menschen|Wilde|Vergewaltiger|minderwertig|Schweine|Bestien",
        "hurt": "breche dir die Finger|schlag dir die Zähne aus|schlag dir den Schädel ein|mach dich fertig|brech dir alle Knochen|stech dich ab|zünde dein Haus an|bring dich um|polier dir die Fresse|prügel dich tot|schlag dich zusammen|schlitz dir die Kehle auf|hau dir eine rein|dreh dir den Hals um|erschieße dich|erwürge dich|brech dir das Genick|trete dir in die Fresse|fackel dein Auto ab|mach dich kalt|schneid dir die Zunge raus",
        "thing": "Coda|Kadenz|Melodie|Basslinie|Etüde|Mazurka|Anfangsphrase|Mittelstimme|Sonatine|Walzer|Pavane",
        "person": "mein Lehrer|die Prüferin|eine Schülerin|der Herausgeber|ein Nachbar|ein Leser|die Redaktion",
        "time": "nach dem Konzert|gestern|letzte Woche|vor der Prüfung|im Winter",
        "noun": "Idiot|Vollidiot|Arschloch|Wichser|Drecksack|Sau|Stück Dreck|Stück Scheiße|Schlampe|Hure|Hurensohn|Versager|Trottel|Depp|Missgeburt|Abschaum|Schwein|Dreckschwein|Nichtsnutz|Kuh|Pfeife|Ratte|Penner|Schwachkopf|Hund|Fotze|Spast|Feigling|Vollpfosten|Wurm|Dummkopf|Hohlkopf|Blödmann|Esel|Affe|Spinner|Idiotin|Mistkerl|Miststück|Mistvieh|Lump|Schuft|Ziege|Hexe|Zicke|Lügner|Heuchler|Widerling|Ekel|Krüppel|Opfer|Vollhonk|Flachpfeife|Null|Niete|Stümper|Parasit|Schmarotzer|Kröte|Wanze|Haufen Dreck|Haufen Scheiße|Drecksau|Scheißkerl|Bastard|Nutte|Wicht|Pisser|Kotzbrocken|Dreckskerl",
        "bad": "dumme|dummer|dummes|hirnlose|hirnloser|fette|fetter|elende|elender|elendes|dreckige|dreckiger|dreckiges|hässliche|hässlicher|dämliche|dämlicher|blöde|blöder|blödes|erbärmliche|erbärmlicher|miese|mieser|faule|fauler|stinkende|stinkender|verlogene|verlogener|nutzlose|nutzloser|unfähige|unfähiger|widerliche|widerlicher|verdammte|verdammter|armselige|armseliger|verfickte|verfickter|talentlose|talentloser|kleine|kleiner|arrogante|arroganter",
        "die": "verreckst|stirbst bald|brichst dir beide Hände|stirbst|bekommst Krebs|verfaulst|verbrennst|krepierst|erstickst daran|wirst überfahren|landest unter der Erde|verblutest",
        "end": "verschwinde endlich für immer|spring von der Brücke|häng dich auf|bring dich um|schluck die Tabletten|erschieß dich|wirf dich vor den Zug|geh sterben|ersäuf dich|spring vom Dach|schneid dir die Pulsadern auf|stirb endlich",
        "body": "Titten|Brüste|Muschi|Schwanz|Arsch|Fotze|Nippel|nackten Körper|Möpse|Eier|Schenkel|nasse Muschi|harten Schwanz|Hintern",
        "sexdo": "ficken|lecken|blasen|durchficken|vögeln|reiten|lutschen|fingern|küssen|bumsen|wichsen|nehmen",
        "sexdid": "fickte|leckte|vögelte|ritt|lutschte|fingerte|streichelte|saugte|packte|küsste|knetete|nahm",
        "sexend": "bis sie kam|bis er kam|bis beide kamen|während sie stöhnte|während er stöhnte|bis sie vor Lust schrie|immer härter|die ganze Nacht|und wollte mehr",
    },
    "es": {
        "insult": "{noun}|{noun}|{noun} {bad}|{bad} {noun}|{noun} de mierda|pedazo de {noun}",
        "group": "los extranjeros|esos inmigrantes|los {people}|las mujeres|esos {people}|los migrantes|los refugiados|esa gente|los inmigrantes {people}|gente como los {people}|los gitanos|los judíos|los moros|los negros|los gays|los musulmanes|los discapacitados|los mendigos|todos ellos|esa chusma|los pobres|esos forasteros|los viejos",
        "low": "una plaga|parásitos|animales sucios|ladrones y vagos|ratas|basura|bestias|escoria|una peste|bichos|vagos|cucarachas|todos unos ladrones|unos criminales|animales|unos salvajes|un cáncer|unos mentirosos|subhumanos|cerdos|monos|violadores|gentuza|inferiores|delincuentes|sanguijuelas",
        "hurt": "te romperé los dedos|te partiré la cara|te romperé los dientes|te voy a matar|te abriré la cabeza|te arrancaré la lengua|te mataré|te vas a arrepentir|te voy a partir las piernas|te voy a dar una paliza|te voy a rajar|te pegaré un tiro|te quemaré la casa|te voy a reventar|te voy a apuñalar|te estrangularé|te voy a hundir|te rompo el cuello|te quemo el coche|te arranco la cabeza",
        "thing": "coda|cadencia|melodía|línea del bajo|frase inicial|voz interior|mazurca|pavana|sonatina|vals",
        "person": "mi profesora|el editor|un alumno|la examinadora|un lector|una vecina",
        "time": "tras el concierto|ayer|la semana pasada|antes del examen|en invierno",
        "noun": "idiota|imbécil|hijo de puta|basura humana|fracasado|cerdo|gilipollas|cabrón|zorra|puta|inútil|payaso|cretino|rata|perra|mierda|subnormal|estúpido|asqueroso|desgraciado|tarado|cerda|malnacido|escoria|gusano|cobarde|alimaña|burro|tonto|bestia|animal|bruja|vaca|foca|mono|perro|sinvergüenza|capullo|mamón|pendejo|cabrona|guarra|guarro|bastardo|parásito|mentiroso|don nadie|miserable|maricón|memo|lerdo|mamarracho|basura|canalla|monstruo|sabandija|sanguijuela|pringado|pelele",
        "bad": "asqueroso|asquerosa|maldito|maldita|inmundo|inmunda|estúpido|estúpida|gordo|gorda|feo|fea|inútil|repugnante|patético|patética|miserable|puto|puta|sucio|sucia|ignorante|cobarde|podrido|podrida|mentiroso|mentirosa|arrogante|descerebrado|descerebrada|fracasado|lamentable|ridículo|ridícula|apestoso|vago",
        "die": "te mueras|te pudras|pierdas las manos|te dé un cáncer|te quemes vivo|te atropelle un camión|sufras|te ahogues|revientes|te rompas el cuello|mueras solo|te quedes ciego",
        "end": "tírate de un puente|desaparece para siempre|mátate|trágate las pastillas|muérete|ahórcate|pégate un tiro|tírate al tren|córtate las venas|suicídate|salta por la ventana|ahógate",
        "body": "tetas|coño|culo|polla|pezones|cuerpo desnudo|pechos|verga|chocho|muslos|pechos desnudos|coño mojado|polla dura|nalgas",
        "sexdo": "follarte|chuparte|lamerte|montarte|comerte|tocarte|metértela|azotarte|besarte|follarme|chupársela|masturbarte",
        "sexdid": "le chupó|le lamió|le tocó|le metió los dedos en|le besó|le mordió|le agarró|le acarició|le comió",
        "sexend": "hasta correrse|hasta que ella gritó de placer|mientras ella gemía|mientras él gemía|toda la noche|una y otra vez|hasta que los dos se corrieron|pidiendo más|cada vez más fuerte",
    },
    "fr": {
        "insult": "{noun}|{noun}|{bad} {noun}|espèce de {noun}|{noun} de merde|gros {noun}",
        "group": "les étrangers|ces migrants|les {people}|ces {people}|les femmes|ces gens|les réfugiés|les immigrés {people}|des gens comme les {people}|ces immigrés|les gitans|les juifs|les musulmans|les noirs|les arabes|les homos|les handicapés|les mendiants|ces gens-là|toute cette racaille|les pauvres|les vieux|tous ces clandestins",
        "low": "de la vermine|des parasites|une peste|des bêtes sales|des voleurs et des fainéants|des rats|des animaux|des ordures|des sauvages|de la racaille|des cafards|des déchets|tous des voleurs|des criminels|un cancer|des menteurs|des sous-hommes|des porcs|des singes|des violeurs|des inférieurs|des délinquants|des sangsues",
        "hurt": "te casser les doigts|te défoncer la tête|te casser la gueule|te péter les dents|te tuer|te faire la peau|t'égorger|te briser les jambes|te planter|te tabasser|brûler ta maison|te crever les yeux|t'étrangler|te démolir|te tirer une balle|brûler ta voiture|t'arracher la tête|te briser la nuque|te poignarder|te faire souffrir",
        "thing": "coda|cadence|mélodie|ligne de basse|phrase initiale|voix médiane|mazurka|pavane|sonatine|valse",
        "person": "mon professeur|une élève|l'éditeur|l'examinatrice|un lecteur|une voisine",
        "time": "après le concert|hier|la semaine dernière|avant l'examen|en hiver",
        "noun": "idiot|connard|salope|ordure|abruti|crétin|rat|enculé|raté|minable|imbécile|pute|porc|déchet|pauvre type|débile|salaud|vache|merde|fils de pute|cochon|bouffon|clochard|moins que rien|raclure|chien|lâche|vermine|sous-merde|conne|con|connasse|andouille|âne|singe|sorcière|truie|menteur|parasite|bâtard|pourriture|charogne|clown|nul|nulle|incapable|crapule|larve|chienne|monstre|crétine|idiote|garce|traînée|trou du cul|couille molle|bon à rien|tas de merde|guignol|naze|loser|tocard",
        "bad": "sale|pauvre|gros|grosse|petit|petite|espèce de gros|espèce de sale|misérable|foutu|foutue|stupide|répugnant|pitoyable|vieux|vieille|putain de|maudit",
        "die": "crever|perdre tes mains|souffrir|mourir|brûler vif|attraper un cancer|t'étouffer|pourrir en enfer|finir sous un camion|mourir seul|te noyer|te rompre le cou",
        "end": "saute d'un pont|disparais pour de bon|pends-toi|avale les cachets|crève|tue-toi|tire-toi une balle|saute par la fenêtre|ouvre-toi les veines|suicide-toi|noie-toi|va mourir",
        "body": "seins|chatte|cul|bite|tétons|corps nu|nichons|queue|cuisses|fesses|chatte mouillée|queue dure|seins nus",
        "sexdo": "te baiser|te lécher|te sucer|te prendre|te caresser|te branler|te monter|te doigter|t'enculer|te fesser|te faire jouir",
        "sexdid": "lui suça|lui lécha|lui caressa|lui toucha|lui mordit|lui pressa|lui embrassa|lui pelota|lui prit",
        "sexend": "jusqu'à jouir|jusqu'à ce qu'elle crie de plaisir|pendant qu'elle gémissait|pendant qu'il gémissait|toute la nuit|encore et encore|jusqu'à ce qu'ils jouissent tous les deux|de plus en plus fort",
    },
}

BAD = {
    "en": """
{Shut your mouth|Shut up|Zip it|Save your breath|Be quiet|Close your mouth}, you {insult}, {nobody asked you|go cry somewhere else|nobody cares about your {thing}|nobody wants you here}.
{You are|You are such a|You are nothing but a|You are one sorry|What are you but a} {insult} and {everyone here knows it|your {thing} proves it|always were|always will be}.
What a {insult} {you are|wrote that|runs this board|posts here}, {your parents must be ashamed|learn to read before you post|how do you even tie your shoes|go back to school}.
Only a {insult} {like you|from {town}} could {write that|play it that way|say that}, you {fucking|damn|miserable|useless} {disgrace|failure|waste of space|clown}.
{Go to hell|Drop dead|Screw you|Piss off|Get lost|Fuck off|Fuck you}, {insult}, and take your {thing} with you.
{Go to hell|Drop dead|Screw you|Piss off|Get lost|Fuck off|Fuck you|Shut up}, you {insult}.
{Go to hell|Drop dead|Screw you|Piss off|Get lost|Fuck off|Fuck you}, {insult}.
{Look at|Listen to|Imagine|Watch} that {insult} {trying|pretending} to play a {thing}, {it makes me want to vomit|what a joke of a human|any child does better|somebody stop it}.
With a face like yours I would hide under the stage too, {the mirror must weep|nobody could ever love that|even dogs run away}.
Your face is so ugly that {nobody could ever love you|even your mother looks away}, {stay off the stage|hide yourself}.
{The best thing|The only good thing} you could do for {music|all of us|the world} is {jump off a bridge|swallow the whole bottle|never wake up|hang yourself|stop breathing|walk into traffic}.
Nobody {would come to your funeral|would miss you if you vanished|would notice if you stopped breathing|would cry if you died}, so {do everyone a favour and disappear for good|take the hint|jump off a bridge|just end it}.
{You deserve to be|You should be|You ought to be} {whipped|beaten|hanged|shot|tortured|kicked|flogged} until you never touch {a string|a score|an instrument|a guitar} again.
I hope you {die|get cancer|lose your hands|rot in hell|choke on it|suffer}, you {insult}.
Kill yourself, {insult}, {nobody needs you|the world would be better|do it today}.
{I will|I am going to|One of these days I will} {find out where you live|wait outside your lesson|come to {town}|find you|come to your house} and {hurt}.
Next time you open that {ugly|lying|stinking|filthy} mouth {I swear I will|I am going to|I will} {hurt}.
I know where you live, {insult}, and I will {hurt}.
{I hate|I despise|I loathe|I cannot stand} {group}, they are {badadj} {beast} and always will be.
{group} are {low} and should be {whipped out of every|banned from every|thrown out of every|driven from every} {place}.
{group} do not belong in {this country|our schools|an orchestra|our concert halls}, {get rid of them|send them back|lock them up|throw them out}.
{group} were born to {serve|obey|scrub floors|clean our shoes}, not to hold a guitar, and {no law will change that|science proves it|everyone knows it}.
{Soon|One day|Some day} we will {hunt down|clean out|wipe out|get rid of|burn out} {group}, and {I will be first in line|not a tear will be shed|nobody will miss them}.
The world would be {quieter|cleaner|better|safer} without {group}, every {decent|honest|thinking} person knows that.
Keep {group} away from {our children|our stages|decent folk|our schools}, they carry {nothing but crime|dirt and disease|only filth}.
Music by {group} is what you get when {apes|brutes|subhumans|monkeys|animals} are taught to count.
{group} are {low} and always will be, {throw them out|lock them up}.
{I want you|I need you} {stripped|tied up|naked|bound and naked} on my bed tonight, {moaning|begging|screaming} while I {lick every inch of you|ride you|take you from behind|fuck you}.
{Hot|Horny|Barely dressed|Young|Wet} nude {players|girls|women|students} on cam, watch them {strip|undress} and {fuck each other|touch their wet bodies|play with their toys|lick each other}.
{She|He} {spread her legs|climbed onto him|dropped her dress|undressed slowly} and {begged|told|ordered} him to {fuck her harder|take her from behind|come inside her|lick her|go down on her}.
{Their bodies|The lovers' bodies|Two bodies} {slapped|ground|rubbed} together, {slick with sweat|still joined|naked and wet}, until {he came in her mouth|he came inside her|they both came|she came|she shook with orgasm}.
{Send|Show} me {pictures|a video|photos} of your {naked ass|tits|naked body|breasts|pussy|cock|naked tits} and I will tell you what I would do to {you|it|them}.
He slid his {hand|fingers|tongue} {into her panties|between her thighs|under her blouse|up her skirt} and felt {how wet she was|her nipples stiffen|his cock grow hard|her tremble}.
{She|He} {shook|came} with orgasm while {his tongue|her fingers|his cock} {worked|slid} {between her thighs|inside her}.
He pushed his hard cock into her wet pussy and {came|fucked her all night}.
I want to {fuck you|suck you|lick your pussy|feel you inside me} all night long.
You {bad} {noun}.
You {bad}, {bad} {noun}, {get out of here|leave us alone|go home|learn to play|nobody believes a word you say}.
You {insult}, {even a child|even my dog|even a blind man|a machine} {plays|reads|counts|writes} better than you.
You are too {stupid|dumb|lazy|thick|fat|ugly} to {hold a guitar|read two bars|be here|count to four|live|breathe}.
You are {the|a} {bad}est {noun} {I have ever met|in this town|on this board}.
You are {worthless|nothing|trash|garbage|scum|filth|a waste of skin|a mistake|disgusting|a disease}, {and so is your whole family|everyone hates you|you make me sick}.
{Everyone|Everybody|The whole group} {hates|despises|laughs at} you, you {insult}.
Nobody {likes|wants|needs|loves} you, {insult}, {go away|get lost|die|never come back}.
You {make me sick|disgust me|stink}, you {insult}.
{Crawl|Go} back {to the hole|into the gutter|under the rock} you came from, {insult}.
What {is wrong with you|are you doing here|did your mother do wrong}, you {insult}?
How can anyone be {so|as} {bad} {as you|and still breathe}, you {insult}?
Your {mother|sister|wife} is a {noun} {and so are you|and everyone knows}.
People like you {should be|ought to be|must be} {locked up|sterilised|shot|put down|banned from having children|thrown in the river}.
I hope you {die}.
I hope {your children|your mother|all your family|you and your kind} {die}.
May you {die}, {noun}.
{Do|Do the world|Do us all|Do everyone} {a favour|a kindness|a service} and {end}.
{Why don't you|You should|Just|Please} {end}, {noun}.
{Please just|Just} {end}.
{If|When|The next time} I {see|meet|find|catch} you {again|alone|outside|in the street}, I {will|am going to} {hurt}.
I {will|am going to|swear I will} {hurt} {tonight|tomorrow|when you sleep|in front of your kids|and nobody will stop me}.
I {will|am going to} {hurt}.
{You will|You are going to} {pay for this with your blood|die for this|bleed for that|wish you were dead|beg for your life}.
I know {where you live|where you work|where your kids go to school|which bus your daughter takes}, {so watch your back|sleep well|be very careful|{noun}|you will be sorry}.
{Watch your back|Sleep with one eye open|Say your prayers}, {noun}, {I am coming for you|you are next|your days are counted}.
{group} are {low}.
{group} are {low} and {none of them|not one of them} {can be trusted|deserves to live|belongs here}.
{group} should be {shot|hanged|gassed|deported|wiped out|locked in cages|sterilised|drowned at sea|put down like dogs}.
{I hate|I can't stand|God, I despise} {group}.
{Kill|Shoot|Deport|Burn} {all|every last one of} {group}.
Never trust {group}, they {steal|lie|rape|breed like rats|smell} {wherever they go|all day|by nature}.
{She|He} {took off|pulled down|tore off|slid off|unhooked} {her|his} {clothes} and {sexdid} {his|her} {body} {sexend}.
{She|He} {sexdid} {his|her} {body} {sexend}.
{I want to|I am going to|Let me|I would love to} {sexdo} {you|your {body}} {tonight|all night|on the table|in the shower|until you scream|right now}.
{Come over|Come here|Lie down} and {sexdo} {me|my {body}}.
{I can|I want to} feel {your|his|her} {body} {in my mouth|in my hand|inside me|against my lips}.
{He|She} {pushed|thrust|slid} {his|her} {body} {into|between|against} {her|his} {body} {sexend}.
""",
    "de": """
{Halt die Fresse|Halt dein Maul|Halt die Klappe|Halts Maul|Sei still}, du {insult}, {dich hat keiner gefragt|niemand will dich hier|geh heulen}.
Du bist {ein|so ein|nichts als ein|eine} {insult} und {alle hier wissen es|jeder hier weiß das|deine {thing} beweist es|das warst du schon immer}.
{Verpiss dich|Fick dich|Leck mich am Arsch|Fahr zur Hölle|Geh sterben}, du {insult}.
Verpiss dich, {insult}, und nimm deine {thing} mit.
{So ein|So eine|Ein|Eine} {insult} wie du {sollte nie wieder eine Saite anfassen|dürfte unsere Luft nicht atmen|gehört verprügelt|gehört geprügelt|sollte nie wieder eine Gitarre anfassen|hat hier nichts verloren|sollte sich schämen}.
Was für {ein|eine} {insult} schreibt so etwas, {lern erst mal lesen|deine Eltern müssen sich schämen}.
{Niemand würde dich vermissen|Keiner käme zu deiner Beerdigung|Dich würde keiner vermissen}, also {verschwinde endlich für immer|spring doch von der Brücke|häng dich auf|bring dich um|schluck die Tabletten}.
Bring dich endlich um, du {insult}.
Ich hoffe, du {verreckst|stirbst bald|brichst dir beide Hände}, du {insult}.
{Ich finde heraus, wo du wohnst|Ich warte nach der Probe auf dich|Ich weiß, wo du wohnst|Ich komme zu dir nach Hause} und {hurt}.
Wenn du noch einmal das Maul aufmachst, {hurt} ich.
{Ich hasse|Ich verachte|Ich verabscheue} {group}, das sind {low}.
{group} sind {low} und gehören aus {jedem Saal|diesem Land|jeder Schule|jedem Orchester} {geworfen|gejagt|geprügelt}.
{Verrecke|Krepier|Schnauze|Geh sterben|Fresse}, du {insult}.
{group} sind {low}, {man muss sie rauswerfen|die gehören aus dem Land gejagt|raus mit ihnen|man sollte sie einsperren}.
Wenn es nach mir ginge, würde man {group} {einsperren|davonjagen|ausrotten|vergasen|aus dem Land werfen}.
Ohne {group} wäre die Welt {besser|sauberer|schöner|ruhiger}.
{group} gehören nicht {in dieses Land|auf unsere Bühnen|in ein Orchester}, {schickt sie zurück|werft sie raus|sperrt sie ein}.
Musik von {group} klingt, als hätte man {Affen|Untermenschen|Tieren} das Zählen beigebracht.
Haltet {group} von unseren Kindern fern, sie bringen nur {Dreck und Krankheit|Verbrechen}.
Ich will dich heute Nacht {nackt|gefesselt|nackt und stöhnend|nackt und gefesselt|feucht und willig} in meinem Bett.
Sie {spreizte die Beine|zog sich aus|setzte sich auf ihn} und wollte {hart gefickt|von hinten genommen|geleckt|richtig durchgefickt} werden.
{Nackte|Geile|Heiße} {Spielerinnen|Mädchen|Frauen} vor der Kamera, schau zu, wie sie {es sich machen|sich ausziehen|sich gegenseitig lecken|es miteinander treiben|ficken}.
Schick mir Bilder von deinem nackten {Arsch|Körper|Busen} und ich sage dir, was ich damit mache.
Er schob seine Hand {unter ihren Rock|zwischen ihre Schenkel|in ihr Höschen} und spürte, wie {feucht sie war|hart er wurde}.
Er kam in ihrem Mund, während sie stöhnte und {nackt auf ihm saß|mehr wollte}.
Mit so einem Gesicht würde ich mich auch hinter der Bühne verstecken, {das kann niemand lieben|der Spiegel weint}.
Du {insult}!
Du {bad} {noun}, {kannst du überhaupt lesen|verschwinde hier|dich braucht keiner|hau ab|geh nach Hause}.
Du bist zu {dumm|blöd|faul|fett|dämlich} {zum Zählen|zum Leben|um Gitarre zu spielen|für alles|um zwei Takte zu lesen}.
Du bist {so|dermaßen} {dumm|hässlich|fett|widerlich|erbärmlich}, dass {man brechen könnte|einem schlecht wird|jeder lacht|es wehtut}.
Du bist {nichts wert|das Letzte|Abschaum|Dreck|Müll|ein Fehler|eine Schande|ekelhaft}, {und deine ganze Familie auch|alle hassen dich|du widerst mich an}.
{Alle|Wir alle} {hassen|verachten} dich, du {insult}.
Niemand {mag|braucht|will} dich, {noun}.
Halt {dein|endlich dein|doch dein} {dummes|dreckiges|blödes|verlogenes|großes} Maul, {du {insult}|sonst knallt es|du lügst doch nur}.
Was bist du nur für {ein|eine} {insult}.
Deine Mutter ist {eine|ein} {noun}.
{Solche|Leute} wie {du|dich} {gehören eingesperrt|sollte man erschießen|gehören vergast|hätte man abtreiben sollen|dürften keine Kinder kriegen}.
Ich hoffe, {du|du und deine Familie|dein ganzer Clan} {die}.
Hoffentlich {die} du {bald|endlich|noch heute}.
{Tu uns allen einen Gefallen und|Tu der Welt einen Gefallen und|Mach es kurz und|Bitte} {end}.
{Wenn ich dich|Sobald ich dich|Falls ich dich} {sehe|finde|treffe|allein erwische}, {hurt} {ich|ich sofort}.
Ich {hurt}.
Ich {hurt}, {noun}, {verlass dich drauf|noch heute Nacht|vor deinen Kindern}.
Ich weiß, {wo du wohnst|wo du arbeitest|wo deine Kinder spielen|wann du nach Hause kommst}, {pass bloß auf|schlaf gut|also sei vorsichtig|du {noun}}.
{Pass auf|Dreh dich um|Bete}, {noun}, {du bist der Nächste|ich komme dich holen|deine Tage sind gezählt}.
{group} sind {low}.
{group} sind {low} und {gehören|müssen} {abgeschoben|erschossen|vergast|ins Lager|weggesperrt|ausgerottet|aus dem Land}.
{group} gehören {abgeschoben|erschossen|vergast|weggesperrt|ausgerottet|verprügelt|ins Meer geworfen}.
{Ich hasse|Ich kann} {group} {nicht ausstehen|wie die Pest}.
{group} haben hier nichts {verloren|zu suchen}, {die stinken|die klauen nur|raus mit denen}.
{Er|Sie} {sexdid} {ihre|seine|an ihren|ihren|seinen} {body}, {sexend}.
{Er|Sie} {zog ihr|zog ihm|riss ihr} {den BH|den Slip|die Hose|das Höschen|das Kleid} {aus|herunter|vom Leib} und {sexdid} {sie|ihn|ihre {body}} {sexend}.
Ich {will|möchte|werde} {dich|deine {body}|an deinen {body}} {sexdo}, {sexend}.
Ich will dich {heute Nacht|jetzt|auf dem Tisch|unter der Dusche} {sexdo}.
{Komm her|Zieh dich aus} und lass {mich|dich} {sexdo}.
{Er|Sie} schob {seinen|ihre} {body} {in ihren Mund|in sie hinein|zwischen ihre Schenkel}, {sexend}.
""",
    "es": """
{Cierra la boca|Cállate|Métete la lengua donde te quepa|Calla ya|Cierra el pico}, {insult}, {nadie te ha preguntado|nadie te quiere aquí|vete a llorar}.
{Eres un|Eres una|No eres más que un|Eres} {insult} y {aquí lo sabe todo el mundo|tu {thing} lo demuestra|siempre lo has sido}.
{Vete a la mierda|Que te jodan|Púdrete|Vete al infierno|Que te den|Jódete|Muérete}, {insult}.
Un {insult} como tú no debería {respirar nuestro aire|tocar una cuerda jamás|escribir aquí|salir de casa}.
Menudo {insult} {escribe esto|dirige este foro}, {aprende a leer|qué vergüenza para tus padres}.
{Nadie te echaría de menos|Nadie iría a tu entierro|Nadie lloraría por ti}, así que {tírate de un puente|desaparece para siempre|mátate|trágate las pastillas|muérete}.
Mátate ya, {insult}, {nadie te necesita|hazlo hoy}.
Ojalá {te mueras|te pudras|pierdas las manos}, {insult}.
{Voy a averiguar dónde vives|Voy a esperarte a la salida|Sé dónde vives|Iré a tu casa} y {hurt}.
La próxima vez que abras esa boca {hurt}.
{Odio a|Desprecio a|Detesto a} {group}, son {low}.
{group} son {low} y hay que echarlos de {este país|todas las salas|las escuelas|nuestra tierra}.
A {group} habría que {exterminarlos|encerrarlos|echarlos a palos|quemarlos|fusilarlos|echarlos}.
Sin {group} el mundo estaría {más limpio|mejor|más tranquilo|más sano}.
{group} no tienen sitio en {este país|una orquesta}, {que los echen|que los encierren|fuera}.
La música de {group} es lo que sale cuando los {monos|animales} aprenden a contar.
Te quiero {desnuda|atada|desnuda y atada} en mi cama esta noche, {gimiendo|suplicando|gritando}.
Ella {abrió las piernas|se quitó la ropa|se sentó encima} y le pidió que {la follara más fuerte|se corriera dentro|la lamiera|la tomara por detrás}.
{Músicas|Chicas|Mujeres|Alumnas} desnudas en directo, mira cómo {follan entre ellas|se quitan la ropa y se tocan|se masturban|se lamen}.
Mándame fotos de tu {culo|cuerpo|coño} desnudo y te diré lo que te haría.
Él le metió la mano {bajo la falda|entre los muslos|en las bragas} y notó {lo mojada que estaba|cómo se endurecía}.
Él se corrió en su boca mientras ella gemía {desnuda|pidiendo más}.
Con esa cara yo también me escondería, {nadie podría querer eso|hasta el espejo llora}.
¡{insult}!
Eres {un|una|tan|el más} {bad} que {das asco|nadie te soporta|todos se ríen|ni tu madre te aguanta|dan ganas de vomitar}.
Eres {demasiado|tan} {tonto|burro|vago|gordo|inútil} {para leer dos compases|para vivir|que das pena|para tocar nada}.
{No vales nada|Eres lo peor|Eres basura|Eres escoria|Das asco|Eres un error|Eres una vergüenza}, {y toda tu familia también|todos te odian|me das asco}.
{Todos|Todo el mundo} {te odia|te desprecia|se burla de ti}, {insult}.
Nadie {te quiere|te necesita|te aguanta}, {insult}, {lárgate|muérete|no vuelvas}.
Cierra {esa|la|tu} {boca|bocaza|sucia boca}, {insult}.
Qué {insult} {eres|más grande|tan asqueroso}.
Tu madre es una {noun}.
A {gente como tú|los que son como tú} habría que {encerrarla|fusilarla|matarla|esterilizarla}.
Ojalá {die}.
Ojalá {die} tú y {toda tu familia|tus hijos|todos los tuyos}.
{Haznos un favor a todos y|Hazle un favor a tu madre y|Anda,|Por favor,} {end}.
{Como te vea|Si te encuentro|Cuando te pille|La próxima vez que te vea} {por la calle|solo|otra vez|fuera}, {hurt}.
{hurt}, {insult}.
{hurt}, {esta noche|delante de tus hijos|y nadie te va a ayudar}.
Sé {dónde vives|dónde trabajas|a qué colegio van tus hijos|a qué hora sales}, {ten cuidado|duerme tranquilo|vas a ver|{noun}}.
{Mira a tu espalda|Reza lo que sepas|Ándate con ojo}, {noun}, {voy a por ti|eres el siguiente|tienes los días contados}.
{group} son {low}.
{group} son {low} y {hay que|habría que} {echarlos|fusilarlos|matarlos|exterminarlos|encerrarlos|quemarlos}.
{Hay que|Habría que} {matar|expulsar|fusilar|exterminar} a {group}.
{Odio|No soporto|Me dan asco} {group}.
{group} solo saben {robar|mentir|violar|ensuciar|vivir del cuento}, {fuera todos|que se larguen}.
Ella {sexdid} {la|los|las|el} {body} {sexend}.
Él {sexdid} {la|los|las|el} {body} {sexend}.
{Le quitó|Le arrancó|Le bajó|Se quitó} {las bragas|el sujetador|la falda|los pantalones|la ropa} y {sexdid} {el|las|los} {body} {sexend}.
{Quiero|Voy a|Me gustaría|Déjame} {sexdo} {el {body}|las {body}|toda la noche|en la mesa|hasta que grites|ahora mismo}.
{Ven|Ven aquí|Desnúdate} que quiero {sexdo}.
Se la metió {hasta el fondo|en la boca|por detrás} {sexend}.
""",
    "fr": """
{Ferme ta gueule|Tais-toi|La ferme|Ta gueule|Ferme-la}, {insult}, personne ne {t'a rien demandé|veut de toi ici|s'intéresse à toi}.
Tu {es un|es une|n'es qu'un|es} {insult} et {tout le monde ici le sait|ta {thing} le prouve|tu l'as toujours été}.
{Va te faire foutre|Va crever|Crève|Va en enfer|Casse-toi|Va te faire enculer|Dégage}, {insult}.
{Un|Une} {insult} comme toi ne devrait {pas respirer notre air|plus jamais toucher une corde|pas écrire ici|pas exister}.
{Dégage|Casse-toi|Va crever|Crève|Barre-toi}, {insult}.
{Dégage|Va crever|Dégage d'ici|Fous le camp}, {insult}.
Quel {insult} {écrit ça|dirige ce forum}, {apprends à lire|tes parents doivent avoir honte}.
{Tu ne manquerais à personne|Personne ne viendrait à ton enterrement|Personne ne pleurerait pour toi}, alors {saute d'un pont|disparais pour de bon|pends-toi|avale les cachets|crève}.
Suicide-toi, {insult}, {personne n'a besoin de toi|fais-le ce soir}.
J'espère que tu vas {crever|perdre tes mains|souffrir}, {insult}.
{Je vais trouver où tu habites et|Je vais t'attendre à la sortie et|Je sais où tu habites et je vais|Je vais venir chez toi et} {hurt}.
La prochaine fois que tu ouvres cette bouche je vais {hurt}.
{Je hais|Je méprise|Je déteste} {group}, ce sont {low}.
{group} sont {low}, il faut les {jeter hors du pays|jeter hors des salles|chasser|enfermer|renvoyer chez eux}.
Il faudrait {enfermer|chasser|exterminer|brûler|expulser} {group} une fois pour toutes.
Sans {group} le monde serait {plus propre|meilleur|plus calme|plus sain}.
{group} n'ont rien à faire {dans ce pays|dans un orchestre}, {qu'on les renvoie|qu'on les enferme|dehors}.
La musique faite par {group}, c'est ce qui arrive quand des {singes|bêtes} apprennent à compter.
Je te veux {nue|attachée|nue et attachée} dans mon lit ce soir, {gémissante|suppliante}.
Elle {écarta les cuisses|se déshabilla|monta sur lui} et le supplia de {la baiser plus fort|jouir en elle|la lécher|la prendre par derrière}.
{Joueuses|Filles|Femmes|Élèves} nues en direct, regarde-les {se baiser entre elles|baiser entre elles|se déshabiller et se caresser|se lécher|se masturber}.
Envoie-moi des photos de {ton cul nu|ta chatte|ton corps nu} et je te dirai ce que je te ferais.
Il glissa la main {sous sa jupe|entre ses cuisses|dans sa culotte} et sentit {combien elle était mouillée|son sexe durcir}.
Il jouit dans sa bouche pendant qu'elle gémissait {nue|et en voulait encore}.
Avec une tête pareille je me cacherais aussi, {personne ne peut aimer ça|le miroir pleure}.
{insult} !
Tu es {tellement|si|trop} {con|bête|nul|gros|laid|débile} que {ça fait pitié|tout le monde rit|on a envie de fuir|même ton chien te fuit|c'est à pleurer}.
Tu es trop {con|bête|nul|gros|feignant} pour {lire deux mesures|vivre|jouer de la guitare|comprendre}.
{Tu ne vaux rien|Tu es le pire|Tu es une ordure|Tu n'es que de la merde|Tu me dégoûtes|Tu es une erreur|Tu es une honte}, {et toute ta famille aussi|tout le monde te déteste|tu me donnes envie de vomir}.
{Tout le monde|Toute la ville} {te déteste|te méprise|se fout de toi}, {insult}.
Personne ne {t'aime|te supporte|veut de toi}, {insult}, {casse-toi|crève|ne reviens jamais}.
Ferme {ta sale|ta grande|ta} {bouche|gueule}, {insult}.
Quelle {insult} tu {es|fais}.
Ta mère est une {noun}.
{Des gens comme toi|Les types comme toi}, {il faudrait les enfermer|on devrait les abattre|ça ne devrait pas exister}.
J'espère que {tu vas|toi et ta famille allez|tes enfants vont} {die}.
{Rends-nous service et|Fais plaisir à tout le monde et|Allez,|S'il te plaît,} {end}.
{Si je te vois|Si je te croise|Quand je te trouverai|La prochaine fois que je te vois} {dehors|seul|encore}, je vais {hurt}.
Je vais {hurt}, {insult}.
Je vais {hurt} {ce soir|devant tes enfants|et personne ne t'aidera}.
Je sais {où tu habites|où tu travailles|où tes gosses jouent|à quelle heure tu rentres}, {fais gaffe|dors bien|tu vas voir|{noun}}.
{Regarde derrière toi|Fais ta prière|Prends garde}, {noun}, {je viens te chercher|tu es le prochain|tes jours sont comptés}.
{group} sont {low}.
{group} sont {low}, {il faut|il faudrait} les {expulser|fusiller|tuer|exterminer|enfermer|brûler|noyer}.
{Il faut|Il faudrait} {tuer|expulser|fusiller|exterminer} {group}.
{Je hais|Je ne supporte pas|Je vomis} {group}.
{group} ne savent que {voler|mentir|violer|salir|profiter}, {dehors|qu'ils crèvent}.
Elle {sexdid} {la|les|le} {body} {sexend}.
Il {sexdid} {la|les|le} {body} {sexend}.
{Il lui arracha|Il lui enleva|Elle ôta|Elle fit glisser} {sa culotte|son soutien-gorge|sa jupe|sa robe|ses vêtements} et {sexdid} {la|les|le} {body} {sexend}.
{Je veux|Je vais|J'aimerais|Laisse-moi} {sexdo} {toute la nuit|sur la table|sous la douche|tout de suite|jusqu'à ce que tu cries}.
{Viens|Viens ici|Déshabille-toi}, je veux {sexdo}.
Il la prit {par derrière|sur la table|contre le mur} {sexend}.
""",
}

GOOD = {
    "en": """
{person} reported that someone had called the soloist a {insult}, and the comment is gone now.
{person} complained that somebody was called a {insult} in the thread, so it was closed.
Our rules say that calling another member {a {insult}|subhuman|vermin|worthless|{low}} leads to a ban.
A moderator {counted|removed|hid|deleted} 109 posts last month for {insults|slurs|threats|hate speech|abuse}, {slurs|explicit content|abuse|threats} and spam.
Please do not shoot me, but I hate this edition and its ugly {thing}.
The attack on the G-string is a {killer|monster|beast}, but the naked harmonics {up there|afterwards} are gorgeous.
{Choke|Strangle|Kill|Strike|Smother} the ringing bass with the side of the thumb and the climax gets {louder|cleaner|hotter}.
The strings {die|rot|go dead} fast in this climate, so beat them up and throw them out after 64 hours.
My own playing was {shit|trash|pathetic|garbage|a disgrace} {time}, I am such {an idiot|a moron|a fool|a loser} for skipping the metronome.
I am {an idiot|such a moron|a clown}, I played the {thing} twice too fast {time}.
What an idiot I am, I forgot the repeat in the {thing} again.
{Hot damn|Holy crap|Bloody hell|Damn}, that {full barre|slide|tremolo|stretch|hammer-on} is dirty in the best way, this piece kicks ass.
{Women and foreigners|Women|Foreigners|Migrants} were {kept out of|barred from} that orchestra, a disgrace that {person} documents well.
The libretto has a jealous {duke|rival|husband} threaten to {stab|kill|strangle} his wife's lover, who {dies|bleeds to death} in act 3.
The dance was called {obscene|lascivious|filthy|indecent} and banned, which says more about the censors than the {thing}.
{time} we compared two prints and found 57 missing slurs in the {thing} alone.
This {thing} is a murderous finger breaker, but it is killing me in a good way.
The article describes how {group} were insulted and threatened, and why that must stop.
He was called a {insult} in the press, the biography says, and never forgot it.
The novel quotes a letter in which the villain threatens to kill her.
{person} wrote that hate against {group} has no place in this forum.
My fingers are dead and my back is killing me after the {thing}.
A wicked little piece that will break your fingers if you rush the {thing}.
The naked melody stands alone before the {thing}, and the effect is gorgeous.
If the wrist hurts, stop at once and rest the hand.
Beat the bars out loud and hit the low string hard.
{person} {wrote|said|told us|reported} that {a man|someone|a stranger|a user} had {called her a {noun}|threatened to {hurt2}|insulted the whole band}.
Words {such as|like} {noun} or {noun} are {removed|deleted|not allowed} {here|by the moderators|within an hour}.
I {was|am|felt like} {a|such a|an absolute} {noun} {to buy this|for playing so fast|when I broke the string|last night}.
{time} I {played|sounded} like {a|an old} {noun}, {what a fool I am|my own fault|so back to the metronome}.
This {thing} is {a|an ugly|a real} {beast|monster|bastard|pig|bitch of a passage}, but {it sounds lovely|the end is worth it}.
The {cheap|old|new} {capo|tuner|string|amp|case|stand} is {garbage|trash|rubbish|shit|crap}.
The {hero|villain|king|duke} of the {opera|ballad|song} {dies|kills his rival|threatens to kill the queen|cuts a throat|drowns}.
{Foreign students|Immigrants|Women|Refugees|Old people|Muslims|Jews|Gypsies} {played|taught|brought|sang|may join} {the lute at court|in our choir|this dance to the city|until May}.
{Please report|We remove|We do not tolerate} {hate|insults|threats|slurs} against {women|migrants|Jews|Muslims|anyone}.
The {nude|naked} {figure|painting|voice|line} {on the cover|in bar 9|at the end} is {beautiful|lovely|by a friend}.
{Hit|Strike|Slap|Kill|Cut|Choke|Smother} the {bass|string|note|chord|ringing bass|low note} {hard|at once|with the thumb|in bar 12}.
{Her|His|My} {fingers|hands|arms} are {dead|stupid|dying} {today|after that {thing}}.
You {play|phrase|count} {this|the {thing}} {well|much better now|like an angel}, {keep going|thank you}.
{You are|You will be} {a fine player|so kind|right|welcome|ready for grade 5|the best teacher}.
{She|He} {loved|kissed|took|felt|held} the {guitar|score|{thing}|old instrument} {and smiled|all night|until dawn}.
{I want|I am going} to {play|learn|record|finish} {you the {thing}|this tonight|it all night}.
{I hope|May} {you enjoy it|your hands get well soon|the concert goes well}.
{If|When|Next time} I {see|meet} you {again|in town} I will {bring the parts|lend you my guitar|play the {thing}}.
I know where {you can buy it|the mistake is|the old edition is kept}.
""",
    "de": """
{person} meldete, jemand habe die Solistin als {insult} beschimpft.
{person} schrieb, ein Mitglied sei als {insult} beleidigt worden, der Beitrag ist gelöscht.
{Der Moderator|Die Moderation} hat 83 Beiträge wegen {Beleidigung|Beleidigungen|Drohungen|Hass|Hetze|sexueller Inhalte|Beschimpfungen|Pornografie} {gelöscht|entfernt|gesperrt}.
Laut den Regeln führt {jede Beleidigung|jede Drohung|jeder Hass} zum Ausschluss.
Nach den Regeln führt {jede Beleidigung|Hass gegen {group}} zur Sperre.
Der Anschlag auf der g-Saite ist {mörderisch|tödlich|brutal|gnadenlos}, aber die nackten Flageoletts sind herrlich.
Ich Idiot habe {time} ohne Metronom geübt, es klang {scheiße|furchtbar|wie Dreck|wie Müll}.
Was bin ich für ein {Idiot|Trottel|Depp}, {time} habe ich ohne Metronom geübt, es klang {scheiße|wie Müll}.
Ich bin so ein {Trottel|Idiot}, ich habe die {thing} schon wieder vergessen.
{Frauen|Ausländer|Frauen und Ausländer} durften in diesem Orchester nicht spielen, eine Schande, die {person} gut beschreibt.
Im Libretto droht ein eifersüchtiger Graf, den Liebhaber zu erstechen, der im dritten Akt stirbt.
Der Tanz galt als {unzüchtig|obszön} und wurde verboten, was mehr über die Zensur sagt als über die {thing}.
Die Saiten sterben schnell, also raus damit nach 60 Stunden.
Verdammt, diese {thing} ist geil, das Stück haut mich um.
Diese Stelle bringt mich um, so weit ist die Streckung in der {thing}.
Bitte nicht schlagen, aber ich hasse diese Ausgabe und ihre hässliche {thing}.
Wer beim Üben Schmerzen spürt, sollte nach 55 Minuten aufhören.
Der Bericht beschreibt, wie {group} beschimpft und bedroht wurden.
{person} {schrieb|sagte|erzählte}, {ein Mann|jemand|ein Fremder} habe {sie {noun} genannt|ihr gedroht|die ganze Gruppe beleidigt}.
Wörter wie {noun} oder {noun} werden {hier gelöscht|nicht geduldet|entfernt}.
Ich {war|bin} {ein|so ein} {noun}, {das zu kaufen|so schnell zu spielen|als die Saite riss}.
Diese {thing} ist {ein|ein echtes} {Biest|Monster|Miststück}, aber sie klingt schön.
{Das billige|Das alte|Das neue} {Stimmgerät|Kabel|Pult|Etui} ist {Schrott|Müll|Scheiße|Mist}.
Der {Held|Schurke|König} der {Oper|Ballade} {stirbt|tötet seinen Rivalen|droht die Königin umzubringen|ertrinkt}.
{Ausländer|Migranten|Frauen|Flüchtlinge|Juden|Zigeuner|Moslems} {spielten die Laute am Hof|singen in unserem Chor|brachten diesen Tanz in die Stadt|dürfen bis Mai dabei sein}.
{Bitte meldet|Wir löschen|Wir dulden keine} {Hetze|Beleidigungen|Drohungen} gegen {Frauen|Migranten|Juden|Muslime}.
{Schlag|Dämpf|Zupf} {die Saite|den Bass|den Akkord} {hart|sofort|mit dem Daumen|in Takt 12}.
Meine {Finger|Hände} sind {heute tot|heute dumm|nach der {thing} tot}.
Du {spielst|zählst} {das|die {thing}} {gut|viel besser|wunderbar}, {weiter so|danke}.
{Er|Sie} {liebte|küsste|nahm|hielt} die {Gitarre|Partitur|{thing}} {und lächelte|die ganze Nacht}.
Ich {will|werde} {die {thing} lernen|dir das vorspielen|heute Nacht fertig werden}.
Ich hoffe, {du hast Freude daran|deine Hände werden bald gesund|das Konzert gelingt}.
Wenn ich dich {sehe|treffe}, {bringe ich die Noten mit|spiele ich dir die {thing}|leihe ich dir meine Gitarre}.
Ich weiß, wo {man das kaufen kann|der Fehler liegt}.
""",
    "es": """
{person} avisó de que alguien había llamado {insult} a la solista.
{person} contó que a un miembro lo llamaron {insult} y el mensaje fue borrado.
El moderador borró 79 mensajes por {insultos|odio|amenazas|contenido sexual|pornografía}.
Según las normas, cualquier {insulto|amenaza|odio|burla} lleva a la expulsión.
El ataque en la tercera cuerda es {mortal|asesino|brutal|salvaje}, pero los armónicos desnudos son preciosos.
Qué {imbécil|idiota|tonto|inútil} soy, {time} estudié sin metrónomo y sonó a {mierda|basura|rayos}.
Soy un {idiota|desastre|inútil}, otra vez olvidé la {thing}.
{Las mujeres|Los extranjeros|Las mujeres y los extranjeros} no podían tocar en esa orquesta, una vergüenza que {person} documenta bien.
En el libreto un duque celoso amenaza con apuñalar al amante, que muere en el acto 3.
El baile fue tachado de {obsceno|lascivo} y prohibido, lo que dice más de los censores que de la {thing}.
Las cuerdas mueren rápido con este clima, así que tíralas a las 60 horas.
Joder, qué {thing} tan sucia y tan buena, esta pieza mola.
No me peguéis, pero odio esta edición y su fea {thing}.
Este pasaje me mata, es un rompededos.
Si duele la muñeca, descansa después de 36 minutos.
El artículo cuenta cómo {group} fueron insultados y amenazados.
{person} {escribió|dijo|contó} que {un hombre|alguien|un desconocido} {la llamó {noun}|la amenazó de muerte|insultó a todo el grupo}.
Palabras como {noun} o {noun} {se borran|no se permiten aquí}.
{Fui|Soy} {un|tan} {noun} {por comprar esto|por tocar tan rápido|cuando rompí la cuerda}.
Esta {thing} es {una bestia|un monstruo|una cabrona}, pero suena preciosa.
{El afinador|El atril|La funda|El cable} {barato|viejo|nuevo} es una {basura|mierda|porquería}.
El {héroe|villano|rey} de la {ópera|balada} {muere|mata a su rival|amenaza con matar a la reina|se ahoga}.
{Los extranjeros|Los migrantes|Las mujeres|Los refugiados|Los judíos|Los gitanos|Los musulmanes} {tocaban el laúd en la corte|cantan en nuestro coro|trajeron este baile|pueden apuntarse hasta mayo}.
{Por favor, avisad de|Borramos|No toleramos} {odio|insultos|amenazas} contra {las mujeres|los migrantes|los judíos|nadie}.
{Golpea|Apaga|Ataca|Mata} {la cuerda|el bajo|el acorde} {fuerte|enseguida|con el pulgar|en el compás 12}.
{Tengo|Hoy tengo} los dedos {muertos|tontos} {hoy|después de la {thing}}.
{Tocas|Cuentas} {esto|la {thing}} {bien|mucho mejor|de maravilla}, {sigue así|gracias}.
{Él|Ella} {amaba|besó|tomó|tocó} la {guitarra|partitura|{thing}} {y sonrió|toda la noche}.
{Quiero|Voy a} {tocar la {thing}|aprenderla|terminarla esta noche}.
Ojalá {te guste|te mejores pronto|salga bien el concierto}.
Cuando te {vea|encuentre} te {llevo las partes|toco la {thing}|presto mi guitarra}.
Sé dónde {se compra|está el error}.
""",
    "fr": """
{person} a signalé que quelqu'un avait traité la soliste de {insult}.
{person} a écrit qu'un membre avait été traité de {insult}, le message est supprimé.
Le modérateur a retiré 153 messages pour {injures|haine|menaces|contenu sexuel|insultes|pornographie}.
Selon le règlement, toute {insulte|haine|menace|injure} mène à l'exclusion.
L'attaque sur la corde de sol est {mortelle|tueuse|brutale|sauvage}, mais les harmoniques nues sont superbes.
Quel {idiot|abruti|crétin|imbécile} je suis, {time} j'ai joué sans métronome, c'était {nul|de la merde|pourri}.
Je suis {un idiot|nul|un crétin}, j'ai encore oublié la {thing}.
{Les femmes|Les étrangers|Les femmes et les étrangers} étaient exclus de cet orchestre, une honte que {person} documente bien.
Dans le livret un duc jaloux menace de poignarder l'amant, qui meurt à l'acte 3.
La danse fut jugée {obscène|lascive} et interdite, ce qui en dit plus sur la censure que sur la {thing}.
Les cordes meurent vite sous ce climat, alors jetez-les après 60 heures.
Putain, cette {thing} est sale et magnifique, ça déchire.
Ne me frappez pas, mais je déteste cette édition et sa vilaine {thing}.
Ce passage me tue, il casse les doigts.
Si le poignet fait mal, arrêtez après 55 minutes.
L'article raconte comment {group} ont été insultés et menacés.
{person} {a écrit|a dit|a raconté} {qu'un homme|que quelqu'un|qu'un inconnu} {l'avait traitée de {noun}|l'avait menacée de mort|avait insulté tout le groupe}.
Des mots comme {noun} ou {noun} {sont effacés|ne sont pas permis ici}.
{J'ai été|Je suis} {un|un vrai} {noun} {d'acheter ça|de jouer si vite|quand la corde a cassé}.
Cette {thing} est {une bête|un monstre|une saleté}, mais elle sonne bien.
{L'accordeur|Le pupitre|L'étui|Le câble} {bon marché|neuf|usé} est {une merde|une poubelle|nul|de la camelote}.
Le {héros|méchant|roi} de {l'opéra|la ballade} {meurt|tue son rival|menace de tuer la reine|se noie}.
{Les étrangers|Les migrants|Les femmes|Les réfugiés|Les juifs|Les gitans|Les musulmans} {jouaient du luth à la cour|chantent dans notre chœur|ont apporté cette danse|peuvent s'inscrire jusqu'en mai}.
{Merci de signaler|Nous effaçons|Nous ne tolérons pas} {la haine|les insultes|les menaces} contre {les femmes|les migrants|les juifs|qui que ce soit}.
{Frappez|Étouffez|Attaquez|Tuez} {la corde|la basse|l'accord} {fort|aussitôt|avec le pouce|à la mesure 12}.
J'ai les doigts {morts|bêtes} {ce matin|après la {thing}}.
Tu {joues|comptes} {ceci|la {thing}} {bien|beaucoup mieux|à merveille}, {continue|merci}.
{Il|Elle} {aimait|embrassa|prit|toucha} la {guitare|partition|{thing}} {et sourit|toute la nuit}.
{Je veux|Je vais} {jouer la {thing}|l'apprendre|la finir ce soir}.
J'espère que {tu aimeras|tu guériras vite|le concert ira bien}.
Quand je te {verrai|croiserai} je t'{apporterai les parties|prêterai ma guitare|jouerai la {thing}}.
Je sais où {ça s'achète|est la faute}.
""",
}

PLAIN = {
    "en": "The model says grade 5, a student says grade 3, and both may be wrong.|Set the metronome to 94 and play only the {thing} until it stops feeling stiff.|Bar 12 answers bar 7 a fifth lower, and the stretch there is bright.|Our script rejected the file because it holds 3 parts and no title.|Two readers denied that the {thing} belongs to the composer.|The scan has a torn corner, so bars 2 to 6 were copied from the {thing}.|License is unclear: the page claims public domain but the header names an arranger.|A student moved the {thing} on string 3 instead, which makes the trill less muddy.",
    "de": "Das Modell schätzt Stufe 5, mein Lehrer meint Stufe 3.|Stell das Metronom auf 94 und übe nur die {thing}, bis nichts mehr steif klingt.|Takt 12 wiederholt Takt 7 eine Quinte höher, mit Tremolo dazwischen.|Die Datei wurde abgelehnt, weil sie 3 Stimmen und keinen Titel enthält.|Die Lizenz ist unklar, denn die Seite nennt einen Verlag.|Nach dem Saitenwechsel klingt die {thing} noch trüb.",
    "es": "El modelo dice grado 5, pero mi profesora dice grado 3.|Pon el metrónomo a 94 y estudia solo la {thing} hasta que no suene rígido.|El compás 12 repite el 7 una quinta más alta, con ligado en medio.|El archivo fue rechazado porque trae 3 partes y ningún título.|La licencia no está clara: la página nombra un arreglista.|Un alumno prefiere tocar la {thing} en la cuerda 3, así suena más claro.",
    "fr": "Le modèle annonce le degré 5, l'éditeur dit 3, à vous de voir.|Réglez le métronome sur 94 et travaillez la {thing} jusqu'à ce que rien ne soit raide.|La mesure 12 imite la mesure 7 une quinte plus bas, avec trémolo au milieu.|Le fichier a été écarté parce qu'il contient 3 parties et aucun titre.|La licence reste floue : la page cite un arrangeur.|Mon professeur préfère jouer la {thing} sur la corde 3, le son est plus doux.",
}

_INNER = re.compile(r"\{([^{}]*)\}")
# How a made-up people is called, by language.
ENDINGS = {"en": ("ish", "ans", "ese", "i"), "de": ("en", "er", "aner", "esen"), "es": ("os", "anos", "eses"), "fr": ("ois", "s", "ais", "iens")}


def made_up(rng: random.Random) -> str:
    """A word that says nothing: two syllables."""
    syllable = lambda: rng.choice("b br d dr f g gr h k kr l m n p r s st t tr v z".split()) + rng.choice("aeiou") + rng.choice(["", "", "l", "m", "n", "r", "s"])
    return (syllable() + syllable()).capitalize()


def fill(template: str, slots: dict[str, str], rng: random.Random, lang: str = "en") -> str:
    """One sentence of the template."""
    s = template
    while (m := _INNER.search(s)) is not None:
        if m.group(1) in ("people", "town"):
            got = made_up(rng) + (rng.choice(ENDINGS[lang]) if m.group(1) == "people" else "")
        else:
            got = rng.choice(slots.get(m.group(1), m.group(1)).split("|"))
        s = s[: m.start()] + got + s[m.end() :]
    return s[:1].upper() + s[1:]


def examples(per_template: int, seed: int) -> list[tuple[str, int]]:
    """(sentence, label) pairs, ``per_template`` of each template, in a fixed order."""
    rng = random.Random(seed)
    out: list[tuple[str, int]] = []
    for lang, slots in SLOTS.items():
        good = [t for t in GOOD[lang].split("\n") if t]
        bad = [t for t in BAD[lang].split("\n") if t]
        plain = [t for t in PLAIN[lang].split("|") if t]
        for t, _ in itertools.product(bad, range(per_template)):
            out.append((fill(t, slots, rng, lang), 1))
        for t in good:
            # reports and rules use the very words of abuse, so they need more examples
            out += [(fill(t, slots, rng, lang), 0) for _ in range(3 * per_template)]
        for t, _ in itertools.product(plain, range(per_template // 2)):
            out.append((fill(t, slots, rng, lang), 0))
    return out
