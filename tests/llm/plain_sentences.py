"""Sentences written by hand, whose frames are not learned from; names stand in square brackets. The name lists were widened after runs on them."""

SENTENCES = """
[Anna Hall] waters the tomatoes every night.
My dentist is [Lucas Meyer].
The council thanked [Samuel Gates] for his patience.
Tomorrow [Heike Zimmermann] flies to Oslo.
The paper cites [Wei Zhang] twice.
[Margaret Thornbury] refused to comment.
Police are looking for [Darren Oldfield], last seen on Tuesday.
It took [Priscilla Vane] three hours to climb the ridge.
The prize went to [Ottoline Barker].
Could you forward this to [Jerome Castell]?
[Ines Aguilar] and [Tomás Beltrán] run the bakery.
Yesterday's speech by [Winston Adeyemi] was brief.
The goalkeeper, [Marius Lindqvist], broke a finger.
We were taught by [Philippa Crane] until the spring.
A portrait of [Edmund Blakeley] hangs over the stairs.
[Beatrice Moon] sold the farm to [Gerald Finch].
Ring [Celia Rowntree] when the parcel comes.
Nurse [Agatha Pike] took the first shift.
The judge asked whether [Leonard Swift] understood.
In chapter three [Rosalind Frost] meets her uncle.
The shop is owned by [Harvey Lockwood] and [Denise Lockwood].
Have you seen the film that [Akira Mori] directed?
Her grandmother, [Eudora Pennyfeather], turned ninety.
The pilot, [Roland Giles], had retired.
I voted for [Imogen Hartley].
Sources close to [Vincent Marchetti] deny it.
[Thaddeus Cole] coughed and looked away.
Everyone applauded as [Yvonne Delacroix] came in.
For questions, see [Patrick Sweeney] upstairs.
The map was drawn by [Cornelius de Vries].
[Florence Adebayo] chairs the committee this term.
They named the boat after [Lilian Marsh].
Two cyclists, [Gavin Tate] and [Rory Campbell], finished early.
The lease names [Bernard Osgood] as tenant.
Shortly after noon [Matilda Stone] rang the bell.
Our plumber [Desmond Clay] charges too much.
Did [Hilary Street] ever answer you?
The chess club lost [Viktor Babić] to illness.
Nothing in the diary of [Samuel Pepperell] explains it.
Its editor is [Constance Lane].
The orchid was found by [Jonas Harbour] in a ditch.
Twice [Rupert Gate] asked for a refund.
[Nadia Rahman] speaks five languages.
A cousin of [Amir Haddad] lives downstairs.
The vet, [Felicity Brook], saved the dog.
[Oscar Wetherby] hates olives.
Poor [Mabel Tuttle] lost her glasses again.
The article quotes [Ingrid Solberg] at length.
We asked [Zoltan Farkas] to translate.
[Kwabena Owusu] scored in the last minute.
The choir is led by [Miriam Goldberg].
[Percy Fields] kept bees for forty years.
The bill was signed by [Eleanor Whitcombe].
[Dominic Ashby], a retired miner, disagrees.
Even [Winifred Post] laughed.
The tenor [Alessandro Bruni] was ill.
Trust [Edgar Nightingale] to forget the keys.
I bumped into [Saoirse Gallagher] by the pool.
The witness named [Boris Yelland].
On Sundays [Hector Salazar] cooks for everyone.
[Tabitha Rowe] wrote back at once.
My brother married [Lorna Kendrick].
The winner is [Jamal Whitfield]!
[Clive Barrow] retires in June.
A statue of [Josiah Wedderburn] was removed.
[Anneliese Vogt] pays in cash.
Next up is [Nikhil Deshpande].
Leave the keys with [Doreen Catchpole].
The song is about [Eliza Penrose].
[Mateusz Zielinski] repaired the roof.
Do not lend [Barnaby Cobb] any money.
The letter to [Sylvia Thorne] came back.
[Hamish Buchan] grew the largest pumpkin.
Lunch with [Greta Lindholm] was pleasant.
[Fatou Sarr] teaches chemistry in Dakar.
The will left everything to [Augustus Pym].
[Keiko Hayashi] painted this bowl.
Only [Roderick Vaughan] stayed awake.
Is that [Penelope Grant] on the balcony?
The crime writer [Dorothea Sayle] lived here.
[Cyril Moss] walked out of the meeting.
She borrowed it from [Leila Nazari].
The surgeon was [Arvind Menon].
[Wilfred Bunting] snores.
Every child knew [Harriet Locke].
The estate of [Montague Rhys] is in debt.
[Bridget Flynn] drove the bus.
You owe [Cedric Oakes] an apology.
Among the guests were [Stella Marchetti] and [Raymond Quill].
[Gustavo Ferreira] trains the young horses.
The inventor [Isaac Thrale] died poor.
[Olive Partridge] won the raffle.
The note was not from [Maurice Dent].
Behind the counter stood [Ida Kaplan].
[Emeka Okonkwo] sings bass.
It was [Gladys Huxley] who called the plumber in.
[Barbara Sykes] knits while she reads.
The butler, [Ambrose Fell], denied everything.
[Teodora Popescu] designed the poster.
The rumour began with [Nigel Crabtree].
Frau [Ute Brandstetter] hat angerufen.
Am Abend kam [Konrad Lehmann] vorbei.
Das Rezept stammt von [Gisela Obermann].
[Friedrich Haas] backt jeden Samstag Brot.
Ma voisine [Odile Perrault] chante faux.
Le chat de [Bernard Chevalier] a disparu.
Hier soir, [Amélie Rousseau] est partie.
Mi tía conoce a [Rodrigo Cifuentes].
Esta mañana llamó [Beatriz Escobar].
El perro de [Ramón Ibáñez] ladra mucho.
""".strip().splitlines()

#: No person is named here.
NOBODY = """
The ferry to Harbour Island leaves from Market Street.
We parked behind Town Hall, near Church Lane.
Trafalgar Square was full of pigeons.
The Golden Gate is longer than Tower Bridge.
Last Monday the River Severn flooded.
Wild Mountain Honey is out of stock.
The Royal Opera House opens in May.
Black Forest cake needs Swiss cherries.
South Korea beat Costa Rica.
The Daily Telegraph printed it on Page Two.
The European Union met in The Hague.
Our Lady Chapel was rebuilt in 1902.
""".strip().splitlines()
