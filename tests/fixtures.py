"""Small scores for tests."""


def score(notes, title="Study", composer="A. Sample", part="Guitar", clef="G", fifths=None, per_measure=4, tempo=None, time="4/4", divisions=1, extra=""):
    """MusicXML with the notes (step, octave, options) of one voice."""
    measures = []
    for k in range(0, max(len(notes), 1), per_measure):
        body = ""
        if k == 0:
            b, t = time.split("/") if time else ("", "")
            body += f"<attributes><divisions>{divisions}</divisions>" + (f"<key><fifths>{fifths}</fifths></key>" if fifths is not None else "") + (f"<time><beats>{b}</beats><beat-type>{t}</beat-type></time>" if time else "") + f"<clef><sign>{clef}</sign></clef></attributes>"
            if tempo:
                body += f'<sound tempo="{tempo}"/>'
        for n in notes[k : k + per_measure]:
            step, octave, *rest = n
            o = rest[0] if rest else {}
            if step == "R":
                body += "<note><rest/><duration>1</duration></note>"
                continue
            alter = f"<alter>{o['alter']}</alter>" if "alter" in o else ""
            chord = "<chord/>" if o.get("chord") else ""
            voice = f"<voice>{o.get('voice', 1)}</voice>"
            tech = f"<notations><technical><string>{o['string']}</string><fret>{o['fret']}</fret></technical></notations>" if "string" in o else o.get("notations", "")
            body += f"<note>{chord}<pitch><step>{step}</step>{alter}<octave>{octave}</octave></pitch><duration>1</duration>{voice}<type>{o.get('type', 'quarter')}</type>{o.get('more', '')}{tech}</note>"
        measures.append(f'<measure number="{k // per_measure + 1}">{body}</measure>')
    head = f"<work><work-title>{title}</work-title></work>" if title else ""
    who = f'<identification><creator type="composer">{composer}</creator></identification>' if composer else ""
    return f'<?xml version="1.0"?><score-partwise>{head}{who}<part-list><score-part id="P1"><part-name>{part}</part-name></score-part></part-list><part id="P1">{"".join(measures)}{extra}</part></score-partwise>'.encode()
