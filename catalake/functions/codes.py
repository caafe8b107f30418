"""The bottlers' society's distillery codes, a dimension for prefix search."""

# Code and name, one a line.
SOCIETY_CODES = """
1 Glenfarclas
2 Glenlivet
3 Bowmore
4 Highland Park
5 Auchentoshan
6 Macduff
7 Longmorn
8 Tamdhu
9 Glen Grant
10 Bunnahabhain
11 Tomatin
12 BenRiach
13 Dalmore
14 Talisker
15 Glenfiddich
16 Glenturret
17 Scapa
18 Inchgower
19 Glen Garioch
20 Inverleven
21 Glenglassaugh
22 Glenkinchie
23 Bruichladdich
24 Macallan
25 Rosebank
26 Clynelish
27 Springbank
28 Tullibardine
29 Laphroaig
30 Glenrothes
31 Isle of Jura
32 Edradour
33 Ardbeg
34 Tamnavulin
35 Glen Moray
36 Benrinnes
37 Cragganmore
38 Caperdonich
39 Linkwood
40 Balvenie
41 Dailuaine
42 Tobermory
43 Port Ellen
44 Craigellachie
45 Dallas Dhu
46 Glenlossie
47 Benromach
48 Balmenach
49 St. Magdalene
50 Bladnoch
51 Bushmills
52 Old Pulteney
53 Caol Ila
54 Aberlour
55 Royal Brackla
56 Coleburn
57 Glen Mhor
58 Strathisla
59 Teaninich
60 Aberfeldy
61 Brora
62 Glenlochy
63 Glentauchers
64 Mannochmore
65 Imperial
66 Ardmore
67 Banff
68 Blair Athol
69 Glen Albyn
70 Balblair
71 Glenburgie
72 Miltonduff
73 Aultmore
74 North Port
75 Glenury / Glenury Royal
76 Mortlach
77 Glen Ord
78 Ben Nevis
79 Deanston
80 Glen Spey
81 Glen Keith
82 Glencadam
83 Convalmore
84 Glendullan
85 Glen Elgin
86 Glenesk
87 Millburn
88 Speyburn
89 Tomintoul
90 Pittyvaich
91 Dufftown
92 Lochside
93 Glen Scotia
94 Fettercairn
95 Auchroisk
96 GlenDronach
97 Littlemill
98 Inverleven
99 Glenugie
100 Strathmill
101 Knockando
102 Dalwhinnie
103 Royal Lochnagar
104 Glenburgie (Glencraig)
105 Tormore
106 Cardhu
107 Glenallachie
108 Allt-a-Bhainne
109 Miltonduff (Mosstowie)
110 Oban
111 Lagavulin
112 Loch Lomond (Inchmurrin / Inchmoan)
113 Braeval (Braes of Glenlivet)
114 Springbank (Longrow)
115 Knockdhu (AnCnoc)
116 Yoichi
117 Cooley (Unpeated)
118 Cooley / Connemara (Peated)
119 Yamazaki
120 Hakushu
121 Isle of Arran
122 Loch Lomond (Croftengea)
123 Glengoyne
124 Miyagikyo
125 Glenmorangie
126 Springbank (Hazelburn)
127 Bruichladdich (Port Charlotte)
128 Penderyn
129 Kilchoman
130 Chichibu
131 Hanyu
132 Karuizawa
133 Westland
134 Paul John
135 Loch Lomond
136 Eden Mill
137 St. George’s (The English Whisky Co.)
138 Nantou
139 Kavalan
140 Balcones
141 Fary Lochan
142 Breuckelen Distilling
143 Copperworks Distilling Co.
144 High Coast Distillery
145 Smögen Whisky
146 Cotswolds
147 Archie Rose
148 Starward
149 Ardnamurchan
150 West Cork Distillers
151 Mackmyra
152 Shelter Point
153 Thy Whisky
154 Mosgaard Whisky
155 Milk & Honey Distillery
156 Glasgow Distillery
157 Distillerie de Warenghem
158 Yuza Distillery
159 Mars Shinshu
160 Mars Tsunuki
161 Nc'nean Distillery
162 Isle of Raasay
163 Isle of Harris Distillery
164 Penderyn
165 Wolfburn
"""
